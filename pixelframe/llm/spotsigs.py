"""Document fingerprints by SpotSigs, in DataFrame functions only.

A signature is a common word and the chain of the next two content words (words that are not common)
that follow it; of several common words in a row the last is the anchor. A fingerprint is the set of a
text's signatures, as sorted 32-bit hashes. Prose has a common word every few words; lists and junk may have none:
where STRETCH content words pass without one, the word before serves as anchor. Texts without a chain take all
pairs of neighbouring words, texts without a word the text itself.

Sets fall into partitions by length such that two sets with a Jaccard similarity of `floor` or more are in one
partition or in neighbours. `likeness` is the exact similarity; only pairs with an empty set are not intersected for it. `similar` is
pruned Jaccard: pairs from partitions further apart, and pairs whose lengths alone keep them under the floor, are not intersected.

`with_next` brings each row's successor by doc_id without a global sort: rows are dealt by ranges of
doc_id with bounds from approx_percentile, at most a few for each shuffle partition. An id with more rows than a range should have is
dealt on by the hash of its texts, in the order of hashes. The first row of each range is copied to the range before it.

Defined results. Null text is empty: its set is empty, and its likeness to an empty set is 1, to any other
0. A null doc_id sorts before all others, rows with one doc_id go by the hash of their texts, then by text; the last row's successor is the
first, a single row's successor is itself. Repeated rows stay. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, slots

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is it that for on was be by as at with this not are from or an a "
    "der die das und in zu den von mit im für auf ist ein eine des dem sich nicht als auch "
    "le la les de des un une et à du en que qui pour dans par sur est pas au "
    "el los las y del por con una para es al se lo como su"
).split()
#: Similarity from which two texts count as similar.
FLOOR = 0.75
#: Content words in a row after which each further word has its predecessor as anchor.
STRETCH = 8
#: Ranges of doc_id for each shuffle partition.
RANGES = 8
#: Parts of one id at most.
PARTS = 1 << 16


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures (array<int>)."""
    common = sorted(set(ANCHORS))

    def is_common(x: Column) -> Column:
        return F.coalesce(x.isin(common), F.lit(False))

    def spots(w: Column) -> Column:
        # Content words with their place, and the common word right before, if there is one.
        before = lambda x, i: F.when(is_common(F.get(w, i - 1)), F.get(w, i - 1)).alias("anchor")
        marked = F.transform(w, lambda x, i: F.when(~is_common(x), F.struct(x.alias("w"), i.alias("i"), before(x, i))))

        def chains(c: Column) -> Column:
            bare = lambda p, j: F.get(c, j - STRETCH)["i"] == p["i"] - STRETCH
            anchor = lambda p, j: F.when(p["anchor"].isNotNull(), p["anchor"]).when(bare(p, j), F.get(c, j - 1)["w"])
            return F.transform(c, lambda p, j: let(anchor(p, j), lambda a: F.when(a.isNotNull(), F.hash(a, p["w"], F.get(c, j + 1)["w"]))))

        return F.array_compact(let(F.array_compact(marked), chains))

    def of(w: Column) -> Column:
        neighbours = F.transform(w, lambda x, i: F.hash(x, F.get(w, i + 1)))
        return let(spots(w), lambda s: F.when(F.size(s) > 0, s).when(F.size(w) > 0, neighbours).when(
            F.coalesce(text, F.lit("")) != "", F.array(F.hash(text))
        ).otherwise(F.array().cast("array<int>")))

    return F.sort_array(F.array_distinct(let(tokens(text), of)))


def fingerprint(sigs: Column) -> Column:
    """Eight hex digits for each signature."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(2**32 - 1))), 8, "0")), "")


def length_part(sigs: Column, floor: float = FLOOR) -> Column:
    """Partition by set length: lengths within a factor of 1 / floor; -1 for an empty set."""
    return F.when(F.size(sigs) > 0, F.floor(F.log(F.size(sigs)) / -F.log(F.lit(floor)))).otherwise(-1).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets, 0 to 1; 1 for two empty ones."""
    few, many = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(many == 0, F.lit(1.0)).when(few == 0, F.lit(0.0)).otherwise(exact)


def similar(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """Whether the similarity is `floor` or more. What length partitions or lengths exclude is not intersected."""
    few, many = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = (F.abs(length_part(a, floor) - length_part(b, floor)) > 1) | (few < floor * many)
    return F.when(apart, F.lit(False)).otherwise(likeness(a, b) >= floor)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted `bounds` are at most `key`, in two steps of about the root of their number each."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse, every = F.lit(bounds[::step]), F.lit(bounds)
    block = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0))
    return let(block, lambda k: k * step + F.size(F.filter(F.slice(every, k * step + 1, F.lit(step)), lambda b: b <= key)))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text, ghost and next_text of docs(doc_id, text), and the window of this order.

    Rows with ghost = 1 are copies that only serve as successors; drop them last.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    n = RANGES * slots(docs.sparkSession)
    at = docs.agg(F.percentile_approx(key, [k / n for k in range(n)], 10 * n), F.min(key), F.count("*")).head()
    # Ids with more rows than a range should have: fewer than n of them.
    many = {r["key"]: min(PARTS, -(-r["n"] * n // at[2])) for r in docs.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") * n > at[2]).filter("n > 1").collect()}
    bounds = sorted({*(at[0] or []), at[1] if at[1] is not None else 0, *many})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    own = (_range_of(F.col("key"), bounds) - 1).cast("long")
    bucket = own * (2 * PARTS)
    if many:
        # A range that begins with such an id: the id's parts by hash, then what lies behind it.
        parts = F.element_at(F.create_map(*(F.lit(x) for pair in many.items() for x in pair)), F.col("key"))
        part = F.floor((F.shiftright("hash", 32) + F.lit(2**31)) * parts / F.lit(2**32))
        behind = F.when(own.isin([k for k, b in enumerate(bounds) if b in many]), PARTS).otherwise(0)
        bucket = bucket + F.coalesce(part, behind)
    rows = rows.withColumn("bucket", bucket)
    order = Window.partitionBy("bucket").orderBy("ghost", "key", "hash", "text")
    first = rows.groupBy("bucket").agg(F.min_by(F.struct("text", "key", "hash"), F.struct("key", "hash", "text")).alias("least"))
    line = Window.orderBy("bucket")  # one row a range
    before = F.coalesce(F.lag("bucket").over(line), F.max("bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ghosts = first.select(before.alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "least.text", "least.key", "least.hash", F.lit(1).alias("ghost"))
    dealt = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    return dealt.withColumn("next_text", F.lead("text").over(order)), order


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of docs(doc_id, text) and of its edited text, whose last quarter comes from the next text.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, similar_next, length_part.
    """
    rows, order = with_next(docs)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    return (
        rows.withColumn("sigs", signatures(F.col("text")))
        .withColumn("next_sigs", F.lead("sigs").over(order))
        .filter("ghost = 0")
        .withColumn("edited", edited)
        .withColumn("edited_sigs", signatures(F.col("edited")))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("sigs")).alias("fingerprint"),
            fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
            likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
            likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
            similar(F.col("sigs"), F.col("next_sigs")).alias("similar_next"),
            length_part(F.col("sigs")).alias("length_part"),
        )
    )
