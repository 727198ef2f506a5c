"""Merkle manifests, hard negatives and SentencePiece ids against plain versions; nulls, ties, repeated rows and hostile values."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pixelframe.llm import manifest, negatives, sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def up(level):
    return [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]


def climb(level, at):
    """(top, siblings before and after on each level)."""
    path = []
    while len(level) > 1:
        run = at - at % 3
        path.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        level, at = up(level), at // 3
    return level[0], path


def plain_manifest(rows):
    low = -(2**63)
    trees = {}
    for d, s, lang, n, t in rows:
        trees.setdefault(s, []).append((low if d is None else d, leaf(d, s, lang, n, t), d, (s, lang, n, t)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops = [climb([x[1] for x in sorted(trees[s], key=lambda x: x[:2])], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        line = sorted(trees[s], key=lambda x: x[:2])
        for at, (_, own, d, (_, lang, n, t)) in enumerate(line):
            subroot, path = climb([x[1] for x in line], at)
            root, more = climb(tops, k)
            new = own
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                new = leaf(d, s, lang, n, None if t is None else t.replace("\n", ""))
            for a, b in path + more:
                new = sha(a + new + b)
            out.append((d, own, subroot, root, sha("".join(a + b for a, b in path + more)), new, new == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_a_plain_tree(spark, levels):
    r = random.Random(4)
    rows = [(k, r.choice(["a", "a", "a", "b", "é", None, "z" * 30]), r.choice(["en", None]), r.choice([5, None]), r.choice(["x\ny", "x", "", None, f"t{k}\n"])) for k in range(150)]
    rows += [(7, "a", "en", 1, "same")] * 3 + [(None, "a", None, None, None), (None, "lone\n", None, 2, "q")] + [(10**18 + k, "b", "de", 9, "ü\n" * 20) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"Tree": F.lit(1), "pos": F.lit("x"), "digest": F.lit(2), "path": F.lit(3)})
    got = sorted((tuple(x[c] for c in COLUMNS) for x in manifest.digest(df, levels).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {x[-1] for x in got} == {True, False}


def test_manifest_of_one_source_one_row_and_none(spark):
    one = [(4, "s", "en", 1, "a\nb")]
    for rows in (one, [(k, "s", None, None, "x\n") for k in range(4)], [(k, f"s{k}", None, None, "x\n") for k in range(4)]):
        got = sorted((tuple(x[c] for c in COLUMNS) for x in manifest.digest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
        assert got == plain_manifest(rows)
    assert manifest.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_versions_share_what_they_do_not_copy():
    v = manifest.Versions([sha(str(k)) for k in range(27)], 3)
    n, root = len(v.digest), v.root
    tops = {v.replaced(k, sha("new")) for k in range(27)}
    assert len(tops) == 27 and len(v.digest) == n + 27 * 4 and v.root == root
    assert all(v.replaced(k, v.digest[k]) == root for k in range(27))


def plain_negatives(rows):
    use = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((i, k, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for i, k, label, v in use:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, of) for j, m, of, w in use if m != k)
        same = [x for x in scored if x[3] == label][:5]
        for s, j, _, _ in same:
            fit = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("group", [1 << 25, 3000])
def test_negatives_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP_BYTES", group)
    monkeypatch.setattr(negatives, "MEMBERS", 3)
    r = np.random.default_rng(5)
    heads = r.normal(size=(4, 6))
    rows = [(k, (heads[k % 4] * r.uniform(0.2, 1.5) + r.normal(size=6) * 0.4).tolist(), int(r.integers(0, 3))) for k in range(450)]
    rows += [(500, [0.0] * 6, 1), (501, None, 1), (502, [1.0] * 6, None), (550, [1.0, None] + [0.5] * 4, 2), (600, [float("nan")] * 6, 0), (None, [1.0] * 6, 1)]
    rows += [(650, [1.0, 2.0], 1), (651, [], 1), (652, [float("inf")], 1), (100, rows[100][1], 0), (100, rows[100][1], 0), (700, [0.001] * 6, 2), (13, rows[13][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"row": F.lit(1), "v": F.lit("x"), "Tile": F.lit(0)})
    got = negatives.mine(negatives.integer_vectors(negatives.relabelled(df)), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)
    assert negatives.mine(negatives.integer_vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_products_are_exact():
    r = np.random.default_rng(1)
    for size in (100, 1 << 25, 1 << 29):
        a, b = r.integers(-size, size, (5, 4)), r.integers(-size, size, (7, 4))
        assert (negatives.products(a, b) == (a.astype(object) @ b.astype(object).T)).all()
    with pytest.raises(OverflowError):
        negatives.products(np.full((1, 8), 1 << 33), np.full((1, 8), 1 << 33))


def hostile(n):
    r = random.Random(1)
    letters = " ▁\n\tabcdeéß日𐍈.,;0123�\x00'-$_()"
    out = ["", " ", "  ", "▁a", "a▁b", "\n", "a\x00b", "   x  y ", "<s>hi</s>", "<0x41>", "\r\n\t", " " * 50 + "x" + " " * 33, "a" * 5000, "日本語 한국어 العربية", "x　z", None]
    return out + ["".join(r.choice(letters) for _ in range(r.choice([3, 30, 90]))) for _ in range(600)]


def test_pieces_equal_the_library(spark, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = hostile(600) + ["hello world"] * 2 + ["word " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"IDS": F.lit(1), "Rows": F.lit("r"), "chunk": F.lit(2)})
    out = sentencepieces.decode(sentencepieces.encode(df, MODEL), MODEL)
    assert out.columns == ["doc_id", "Rows", "chunk", "ids", "decoded"]
    for x in out.collect():
        want = model.encode(texts[x["doc_id"]] or "", add_bos=True, add_eos=True)
        assert x["ids"] == want and x["decoded"] == model.decode(want), texts[x["doc_id"]]
    digests = sentencepieces.digest(df, MODEL).filter("doc_id < 40").collect()
    for x in digests:
        want = model.encode(texts[x["doc_id"]] or "", add_bos=True, add_eos=True)
        assert x["n_tokens"] == len(want) and x["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert x["decoded_sha256"] == sha(model.decode(want))
    assert sentencepieces.digest(df.limit(0), MODEL).count() == 0


def test_a_full_table_starts_anew_with_the_same_ids(monkeypatch):
    monkeypatch.setattr(sentencepieces, "TABLE_BYTES", 2000)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = sentencepieces.Chunks(sentencepieces.vocabulary(MODEL))
    texts = hostile(600)
    for k in range(0, len(texts), 20):
        ids, rows = table.encoded(texts[k : k + 20])
        assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)] == [model.encode(t or "", add_bos=True, add_eos=True) for t in texts[k : k + 20]]


def test_decoding_of_any_ids_equals_the_library():
    r = random.Random(2)
    model, v = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepieces.vocabulary(MODEL)
    for _ in range(1500):
        ids = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(3, 258), r.randint(259, 31999), 28705]) for _ in range(r.randint(0, 30))]
        assert v.decode(np.array(ids, int)).decode() == model.decode(ids), ids
