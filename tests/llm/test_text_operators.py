"""The text operators on small fixtures: brute force, exact round trips, nulls, empties, ties and clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import chat, html_blocks, minhash, mixing, packing, quality, spotsigs, suffixes, urls, wordpieces
from pixelframe.llm.common import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(n, seed=0):
    r = random.Random(seed)
    pool = ["".join(r.choices("abcdefghié", k=r.randint(1, 8))) for _ in range(300)] + ["the", "of", "and", "der", "la"] * 30
    return [" ".join(r.choices(pool, k=r.randint(0, 220))) + r.choice(["", "\n", ".\n"]) + " ".join(r.choices(pool, k=30)) for _ in range(n)]


def docs_of(spark, rows, extra=True):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    return out.withColumns({"tid": F.lit(1), "key": F.lit("x"), "Kept": F.lit(2), "tokens": F.lit("t"), "_top": F.lit(0)}) if extra else out


@pytest.fixture(scope="module")
def corpus():
    texts = made(40)
    near = texts[3].split(" ")
    near[len(near) // 2] = "changed"
    texts += [texts[3], " ".join(near), texts[3].upper(), "", None, "one two", "one two", " \t\n", "x" * 30_000, "a b c d e " * 400]
    passage = texts[10] + " " + texts[11]
    texts += [texts[20] + passage + texts[21], texts[22] + passage, passage + texts[23]]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "a null id"), (None, None)]


def by_id(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows)


def test_words(spark):
    df = spark.createDataFrame([(" a\tb\x0bc  d\n",), (None,), ("",), ("\x1cx y",)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["a", "b", "c", "d"], [], [], ["\x1cx y"]]


def test_quality_counts_equal_brute_force(spark, corpus):
    rows = corpus + [(900, "a b c a b c x"), (901, "same line\nsame line\n\n\nother"), (902, "# # $ 5"), (903, " ".join(f"w{i}" for i in range(60)))]
    got = quality.judge(docs_of(spark, rows)).collect()

    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r["doc_id"], *(r[c] for c in names)) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[903] and not kept[902]
    assert {"tid", "Kept"} & set(quality.accepted(docs_of(spark, rows)).columns)


def test_cascade_order_changes_no_verdict(spark, corpus):
    docs = docs_of(spark, corpus, extra=False)
    verdicts = set()
    for order in itertools.islice(itertools.permutations(quality.RULES), 0, 720, 179):
        out = docs.select("doc_id", quality.cascade(quality.Facts.of(F.col("text")), list(order)).isNull().alias("k")).collect()
        verdicts.add(tuple(sorted((str(r[0]), r[1]) for r in out)))
    assert len(verdicts) == 1
    planned = quality.plan_cascade(docs, quality.RULES)
    assert {p[0].name for p in planned} == {r.name for r in quality.RULES}
    gain = [share / seconds for _, seconds, share in planned]
    assert gain == sorted(gain, reverse=True) and gain[0] > 0
    assert len(quality.plan_cascade(docs, quality.RULES, sample_rows=5)) == len(quality.RULES)


def fits(host, path, rule):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def test_urls_equal_brute_force(spark):
    r = random.Random(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "net", "q.net", "A.COM"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/y/z", "/xy"]
    rules = [(h, p, r.choice(["allow", "block"])) for h in ["com", "a.com", "b.a.com", "net"] for p in ["", "/x", "/x/y", "/x/y/z"] if r.random() < 0.7]
    rows = [(i, f"http://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=://z', '#f'])}") for i in range(300)]
    rows += [(400 + i, f"http://a.com{p}{x}") for i, (p, x) in enumerate(itertools.product(paths, ["\U0010ffffx", "\U0010ffff", "\uffff/y", "\x00", "é"]))]
    rows += [(None, "http://a.com/x"), (301, None), (302, ""), (303, "no scheme"), (304, "http://"), (304, "http://")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "level": F.lit(1)})
    got = urls.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(rows)
    seen = Counter()
    for g in got:
        host, path = "", ""
        if g["url"] and "://" in g["url"]:
            host, path = re.match(r"([^/?#]*)([^?#]*)", g["url"].split("://", 1)[1]).groups()
        host = host.lower()
        found = [x for x in rules if fits(host, path, x)] if host else []
        best = max(found, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        assert (g["host"], g["path"]) == (host, path)
        assert (g["rule"], g["verdict"]) == ((best[0] + best[1], best[2]) if best else (None, "allow")), g
        seen[g["verdict"]] += 1
    assert len(seen) == 2
    assert {x["verdict"] for x in urls.judge_urls(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


def test_chat_round_trip_of_hostile_turns():
    r = random.Random(1)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "[", "INST]", "/", "ok", "\n", " ", "assistant", "<<TURN>>user", "é"]
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", "system", "", "a<s>b\\"]), "".join(r.choices(bits, k=r.randint(0, 6)))) for _ in range(r.randint(0, 5))]
        text = chat.render(turns)
        read, spans = chat.parse(text)
        assert read == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_chat_query_digests(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a\\"), (2, 0, None, None), (-7, 0, "user", said), (-7, 1, "assistant", said), (3, 0, "user", "x" * 50_000), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert len(got) == 5
    assert got[-7]["loss_chars"] == len(said) and got[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\\\nassistant\nb\n").hexdigest()
    assert got[2]["n_turns"] == 1 and got[2]["loss_chars"] == 0
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def spot_sets(text):
    """Signatures in plain Python, as tuples."""
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    common = set(spotsigs.ANCHORS)
    content = [(k, x) for k, x in enumerate(w) if x not in common]
    out = set()
    for j, (k, x) in enumerate(content):
        follow = content[j + 1][1] if j + 1 < len(content) else None
        if k and w[k - 1] in common:
            out.add((w[k - 1], x, follow))
        elif j >= spotsigs.STRETCH and content[j - spotsigs.STRETCH][0] == k - spotsigs.STRETCH:
            out.add((content[j - 1][1], x, follow))
    if not out and w:
        out = {(x, w[k + 1] if k + 1 < len(w) else None) for k, x in enumerate(w)}
    return out or ({text} if text else set())


def spot_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs_equal_brute_force(spark, corpus):
    r = random.Random(31)
    pool = ["the", "of", "und", "la", "a"] * 8 + [f"w{k}é" for k in range(60)]
    rows = [r for r in corpus if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(3000 + k, " ".join(r.choices(pool, k=r.randint(1, 80)))) for k in range(40)]
    rows += [(4000, "the of and"), (4001, "the of and"), (4002, "cat"), (4003, "!?"), (4004, " ".join(f"x{k}" for k in range(30)))]
    rows += [(4005 + j, "the shared pair here " + " ".join(f"of a{j}{k} b{j}{k}" for k in range(14))) for j in range(2)]
    got = {r["doc_id"]: r for r in spotsigs.compare_edited(docs_of(spark, rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    near = set()
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + follow[:q]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        a, b, c = spot_sets(t), spot_sets(edited), spot_sets(follow)
        assert len(got[i]["fingerprint"]) == 8 * len(a) and len(got[i]["edited_fingerprint"]) == 8 * len(b)
        assert got[i]["near_edited"] == pytest.approx(spot_likeness(a, b)), t
        assert got[i]["near_next"] == pytest.approx(spot_likeness(a, c)), t
        assert got[i]["similar_next"] == (spot_likeness(a, c) >= spotsigs.FLOOR)
        near.add(got[i]["near_next"])
    assert 0.0 in near and 1.0 in near and any(0 < x < 0.1 for x in near)
    assert got[3]["fingerprint"] == got[40]["fingerprint"]
    one = spotsigs.compare_edited(spark.createDataFrame([(1, "the cat sat on the mat")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert spotsigs.compare_edited(docs_of(spark, corpus)).count() == len(corpus)
    assert spotsigs.compare_edited(docs_of(spark, corpus).limit(0)).count() == 0


def test_next_text_where_most_rows_share_an_id(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices(["the", "cat", "dog", "of", "hill"], k=12)) for _ in range(300)]
    rows = [(5, t) for t in texts[:200]] + [(None, t) for t in texts[200:260]] + [(k + 10, t) for k, t in enumerate(texts[260:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, order = spotsigs.with_next(df)
    got = dealt.filter("ghost = 0").select("doc_id", "text", "next_text", "bucket", "hash").collect()
    low = -(2**63)
    line = sorted((low if x["doc_id"] is None else x["doc_id"], x["hash"], x["text"]) for x in got)
    follow = Counter((line[k][2], line[(k + 1) % len(line)][2]) for k in range(len(line)))
    assert Counter((x["text"], x["next_text"]) for x in got) == follow
    assert len({x["bucket"] for x in got if x["doc_id"] == 5}) > 4 and len({x["bucket"] for x in got if x["doc_id"] is None}) > 1


def test_length_parts_lose_no_pair():
    import math

    part = lambda n: math.floor(math.log(n) / -math.log(spotsigs.FLOOR))
    for n in range(1, 3000):
        assert all(abs(part(n) - part(m)) <= 1 for m in (n, max(1, math.ceil(n * spotsigs.FLOOR)), math.floor(n / spotsigs.FLOOR)))


def test_automaton_equals_greedy_longest_match():
    r = random.Random(2)
    letters = [b"ab", b"abc"]
    for trial in range(60):
        abc = letters[trial % 2]
        pieces = {tuple(r.choices(abc, k=r.randint(1, 5))) + ((wordpieces.END,) if r.random() < 0.4 else ()) for _ in range(12)}
        pieces |= {(c,) for c in abc} | {(c, wordpieces.END) for c in abc}
        machine = wordpieces.Automaton(sorted(pieces))
        for _ in range(60):
            word = bytes(r.choices(abc, k=r.randint(1, 14)))
            at, n, symbols = 0, 0, (*word, wordpieces.END)
            while at < len(symbols):
                size = max((k for k in range(1, len(symbols) - at + 1) if symbols[at : at + k] in pieces), default=None)
                if symbols[at:] == (wordpieces.END,):
                    break
                at, n = at + size, n + 1
            assert machine.count(word) == n, (word, sorted(pieces))


def test_token_counts_with_the_real_vocabulary(spark, corpus):
    import public_tokenizers

    pieces = set(wordpieces.read_vocabulary(public_tokenizers.path(wordpieces.VOCABULARY)))
    longest = max(map(len, pieces))
    got = wordpieces.count_pieces(docs_of(spark, corpus)).collect()
    assert len(got) == len(corpus)

    def greedy(text):
        n = 0
        for run in (text or "").split():
            for part in wordpieces.PARTS.findall(run.lower()):
                s = (*part.encode(), wordpieces.END)
                at = 0
                while at < len(s) - 1 or at < len(s) and s[at:] in pieces:
                    at += next(k for k in range(min(longest, len(s) - at), 0, -1) if s[at : at + k] in pieces)
                    n += 1
        return n

    assert sorted((str(r[0]), r["n_pieces"]) for r in got) == sorted((str(i), greedy(t)) for i, t in corpus)


def test_html_labeller_on_held_out_pages():
    r = np.random.default_rng(77)
    pool = html_blocks.made_words(r)
    model = html_blocks.labeller()
    wrong = total = 0
    for _ in range(150):
        text, want = html_blocks.page(r, pool)
        found = html_blocks.leaves(text)
        assert len(found) == len(want)
        wrong += int(((model.predict([html_blocks.Sequence(found)])[0] >= 0.5) != np.array(want, bool)).sum())
        total += len(want)
    assert wrong / total < 0.01


def test_html_pages(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li>"
        "<li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>A title &amp; more</h1><p><b>First one.<br><p>Second \n  one &lt;here&gt;.</p></article>"
        "<div class='comments'><p>Nice text, thanks!</p></div><footer>&copy; us &middot; all rights.</footer></body></ht"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p"), (1, "u", page), (4, "u", "<article><p>" + "word " * 40_000 + "</p></article>")]
    got = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert [g["text"] for g in got if g["page_id"] == 1] == ["A title & more\nFirst one.\nSecond one <here>."] * 2
    assert [g["n_chars"] for g in got if g["page_id"] in (2, 3) or g["page_id"] is None] == [0, 0, 0]
    assert next(g for g in got if g["page_id"] == 4)["n_chars"] == 199_999


def brute_windows(raw, length):
    count = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


@pytest.mark.parametrize("hot", [0, 3, 4000])
def test_suffix_dedup_equals_brute_force(spark, corpus, hot, monkeypatch):
    """hot = 0 parts every group down to single distances, 3 some of them."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = suffixes.digest(docs_of(spark, corpus)).collect()
    want = brute_windows([(t or "").encode() for _, t in corpus], 400)
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(corpus, want, strict=True))


def test_previous_factors_equal_their_definition():
    r = np.random.default_rng(3)
    for _ in range(50):
        run = np.sort(r.integers(0, 6, 30))
        run = np.unique(run, return_inverse=True)[1]
        position = r.permutation(30)
        want = [any(run[j] == run[i] and position[j] < position[i] for j in range(30)) for i in range(30)]
        assert suffixes.earlier(position, run).tolist() == want
        # The nearest smaller position before or after, in suffix order, decides alone.
        for i in range(30):
            left = next((j for j in range(i - 1, -1, -1) if position[j] < position[i]), None)
            right = next((j for j in range(i + 1, 30) if position[j] < position[i]), None)
            assert want[i] == any(j is not None and run[j] == run[i] for j in (left, right))


def test_suffix_dedup_leaves_no_shuffle_files_of_its_tables(spark, corpus):
    """They stayed until the driver happened to collect its garbage, so that at worst all were on disk at once."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p.name for d in folders for p in Path(d).rglob("shuffle_*")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key)
    suffixes.digest(docs_of(spark, corpus))
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(key) == was


def test_windows_of_one_hash_are_confirmed(monkeypatch):
    """With a hash that tells nothing apart the symbols decide."""
    r = random.Random(6)
    contexts = [bytes(r.choices(b"ab", k=6)) + b"anchor" + bytes(r.choices(b"ab", k=6)) for _ in range(40)]
    n = len(contexts)
    args = (np.zeros(n, np.int64), contexts, np.full(n, 6), np.full(n, 5), np.arange(n), np.ones(n, np.int64), 14, True, False)
    want = suffixes.repeated(*args, exact=True)
    plain = suffixes.repeated(*args)
    monkeypatch.setattr(suffixes, "_sums", lambda data: np.zeros(len(data) + 1, np.uint64))
    for got in (plain, suffixes.repeated(*args)):
        assert [(l, sorted(x.tolist())) for l, x in got] == [(l, sorted(x.tolist())) for l, x in want] and want


def test_suffix_dedup_of_a_group_beyond_the_limit(spark):
    """One passage in more texts than HOT contexts, each with other bytes around it."""
    r = random.Random(12)
    letters = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = letters(200)
    rows = [(i, letters(150) + passage + letters(150)) for i in range(suffixes.HOT + 200)]
    rows += [(10_000 + i, letters(150) + passage + rows[i][1][350:450]) for i in range(60)]
    got = suffixes.digest(docs_of(spark, rows, extra=False), 224).collect()
    want = brute_windows([t.encode() for _, t in rows], 224)
    assert sum(w[1] for w in want) >= 120 * 300
    assert sorted((r[0], *r[1:]) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_query_keeps_passages_below_its_bytes_and_pipeline_does_not(spark):
    """57 words that two texts share: as 399 bytes with the blanks around them they stay in the query's result, as 400 they go; the stage by words cuts both."""
    r = random.Random(15)
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    shared = [f"{say(56)} {'z' * k}" for k in (5, 6)]
    assert [len(f" {x} ") for x in shared] == [399, 400] and {len(x.split()) for x in shared} == {57}
    rows = [(i, f"{say(70)}{'xy'[i % 2]} {shared[i // 2]} {'uv'[i % 2]}{say(70)}") for i in range(4)]
    got = sorted(suffixes.digest(docs_of(spark, rows, extra=False)).collect())
    assert [x["n_removed"] for x in got] == [0, 0, 400, 400]
    assert [x["kept_text"] for x in got] == [t.replace(f" {shared[1]} ", "") for _, t in rows]
    assert [shared[i // 2] in t for i, t in sorted(suffixes.remove_copies(docs_of(spark, rows, extra=False)).collect())] == [True, False, True, False]


def brute_first(rows, length, words=True):
    """Texts of `rows` (unique ids) without later copies of windows of words or bytes."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] if words else list(range(len(b)))
        units = re.findall(rb"[^\x20\x09-\x0D]+", b) if words else b
        gone, fresh = bytearray(len(b)), set()
        starts.append(len(b))
        for s in range(len(units) - length + 1):
            w = tuple(units[s : s + length])
            if w in seen or w in fresh:
                for k in range(starts[s], starts[s + length]):
                    gone[k] = 1
            fresh.add(w)
        seen |= fresh
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


@pytest.mark.parametrize(("length", "in_words", "hot"), [(400, False, 4000), (130, False, 2), (51, True, 4000), (51, True, 0), (12, True, 2)])
def test_suffix_dedup_keeps_the_first(spark, corpus, length, in_words, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = [r for r in {r[0]: r for r in corpus if r[0] is not None}.values() if r[0] != 48]
    got = suffixes.remove_copies(docs_of(spark, rows), length, in_words)
    assert got.columns == docs_of(spark, rows).columns and {tuple(x[2:]) for x in got.collect()} == {(1, "x", 2, "t", 0)}
    assert {x[0]: x[1] or "" for x in got.collect()} == brute_first(rows, length, in_words)


def test_passages_of_over_fifty_words_go_and_names_do_not_clash(spark):
    r = random.Random(13)
    pool = ["".join(r.choices("abcdefghiéñ", k=r.randint(1, 9))) for _ in range(4000)]
    say = lambda n: " ".join(r.choices(pool, k=n))
    long, short, letters = say(51), say(40), " ".join(r.choices("abcdefghij", k=51))
    few = spark.createDataFrame([(i, f"{say(20)}\t{x}  end{i} {say(3)}") for i, x in enumerate([letters, letters, letters.replace(" ", "\n"), letters[2:]])], "doc_id long, text string")
    assert [" ".join(x["text"].split()).count(letters) for x in sorted(suffixes.remove_copies(few).collect())] == [1, 0, 0, 0]
    assert [letters[2:] in x["text"] for x in sorted(suffixes.remove_copies(few).collect())] == [True, False, False, True]
    rows = [(i, f"{say(80)} {long} {say(80)} {short} {say(60)}", 7, 8, 9) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tid int, _doc int, _spans int")
    got = sorted(suffixes.remove_copies(docs).collect())
    assert [long in x["text"] for x in got] == [True] + [False] * 19 and all(short in x["text"] for x in got)
    assert all(tuple(x)[2:] == (7, 8, 9) for x in got) and got[0]["text"] == rows[0][1]


def shingle_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("tile", [4, 1024])
def test_near_duplicates_equal_brute_force(spark, corpus, tile, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "NODE_EDGES", 0 if tile == 4 else 10**6)
    r = random.Random(3)
    base = corpus[7][1].split(" ") + corpus[8][1].split(" ")
    rows = list(corpus)
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"new{k}"
        rows.append((1000 + k, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    want = []
    for k, (i, _) in enumerate(rows):
        c = least.get(top(k)) if sets[k] else i
        want.append((str(i), len(sets[k]), c, i == c))
    got = [(str(x[0]), *x[1:]) for x in minhash.near_duplicates(docs_of(spark, rows)).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert minhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0
    assert minhash.one_of_each(docs_of(spark, rows)).columns == docs_of(spark, rows).columns


def test_one_of_each_decides_by_row(spark):
    import corpus_pipeline

    t = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(5)]
    near = t[0].replace("w0x20", "other")
    rows = [(None, t[0]), (7, near), (None, t[1]), (None, t[1].upper()), (None, t[2]), (9, t[3]), (9, t[4]), (9, t[4]), (None, None), (None, " \n"), (9, ""), (3, None), (3, None)]
    got = sorted(corpus_pipeline.near_dedup(spark, docs_of(spark, rows), "").select("doc_id", "text").collect(), key=str)
    one = min((t[1], t[1].upper()), key=lambda x: hashlib.md5(x.encode()).digest())
    want = [(7, near), (None, one), (None, t[2]), (9, t[3]), (9, t[4]), (None, None), (None, " \n"), (9, ""), (3, None), (3, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_packing_plan_is_tight_and_valid():
    r = random.Random(5)
    for room in (10, 37, 100):
        for _ in range(30):
            counts = Counter(r.randint(1, room) for _ in range(r.randint(0, 200)))
            bins = packing.plan(dict(counts), room)
            used = Counter()
            for lengths, times in bins:
                assert sum(lengths) <= room and times > 0
                for x in lengths:
                    used[x] += times
            assert used == counts
            n, least = sum(t for _, t in bins), -(-sum(k * v for k, v in counts.items()) // room)
            assert n <= max(least + 2, int(least * 1.08) + 1, sum(v for k, v in counts.items() if 2 * k > room))


def test_dominance_reduction_keeps_the_optimum():
    def best(items, room):
        n = [len(items) + 1]

        def put(k, bins):
            if len(bins) >= n[0]:
                return
            if k == len(items):
                n[0] = len(bins)
                return
            for b in sorted(set(bins)):
                if b >= items[k]:
                    rest = list(bins)
                    rest.remove(b)
                    put(k + 1, [*rest, b - items[k]])
            put(k + 1, [*bins, room - items[k]])

        put(0, [])
        return n[0]

    r = random.Random(6)
    for _ in range(60):
        items = sorted((r.randint(1, 12) for _ in range(r.randint(1, 8))), reverse=True)
        fixed, left = packing.reduce_instance(dict(Counter(items)), 12)
        rest = sorted((x for x, k in left.items() for _ in range(k)), reverse=True)
        assert sum(t for _, t in fixed) + (best(rest, 12) if rest else 0) == best(items, 12)


def test_packed_documents(spark, corpus):
    rows = corpus + [(2000, "<|endoftext|> and  double  blanks \n x"), (2001, "tail ")]
    got = packing.pack_documents(docs_of(spark, rows)).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    json = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = json.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((str(x[0]), *x[1:5]) for x in got) == sorted(want)
    at = {}
    for x in got:
        at.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(s[1] for s in spans) <= 1024
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert packing.pack_documents(docs_of(spark, rows).limit(0)).count() == 0


def raked(tokens, goals, rounds=500):
    """Iterative proportional fitting in numpy: tokens by cell, goals by axis."""
    w = tokens / tokens.sum()
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            sums = w.sum(axis=tuple(k for k in range(w.ndim) if k != axis), keepdims=True)
            w = w * np.divide(goal.reshape(sums.shape), sums, out=np.zeros_like(sums), where=sums > 0)
    return w


def test_raking_equals_numpy(spark):
    r = np.random.default_rng(9)
    tokens = r.integers(1, 5000, (4, 3, 3)).astype(float)
    tokens[0, 1, 2] = 0
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(tokens[a, b, c])) for a, b, c in np.ndindex(tokens.shape) if tokens[a, b, c]]
    facts = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    table = spark.createDataFrame([("lang", "l0", 0.5), ("lang", "l1", 0.3), ("lang", "l2", 0.2), ("source", "s3", 0.4)], "dimension string, value string, share double")
    sums = [tokens.sum(axis=tuple(k for k in range(3) if k != axis)) ** mixing.TEMPER for axis in range(3)]
    goals = [s / s.sum() for s in sums]
    goals[1] = np.array([0.5, 0.3, 0.2])
    goals[0] = np.append(goals[0][:3] / goals[0][:3].sum() * 0.6, 0.4)
    want = raked(tokens, goals) / np.maximum(tokens, 1) * tokens.sum()
    got = {(x["source"], x["lang"], x["topic"]): x for x in mixing.calibrated(facts, table).collect()}
    assert len(got) == len(rows)
    rates = sorted(((want[a, b, c], tokens[a, b, c]) for a, b, c in np.ndindex(tokens.shape) if tokens[a, b, c]), reverse=True)
    over = np.cumsum([n for _, n in rates])
    top = rates[int((over <= mixing.SLACK * tokens.sum()).sum())][0]
    for (s, l, t), x in got.items():
        rate = want[int(s[1]), int(l[1]), int(t[1])]
        assert x["rate"] == pytest.approx(rate, rel=1e-4) and x["marginal_error"] <= mixing.TOLERANCE
        assert x["probability"] == pytest.approx(min(1, rate / top), rel=3e-3)


def test_mix_samples_by_its_probabilities(spark):
    r = random.Random(8)
    pool = [[f"{k}w{i}" for i in range(40)] for k in range(3)]
    rows = [(i, " ".join(r.choices(pool[i % 3], k=r.randint(0, 60))), r.choice(["en", "en", "fr", None]), r.choice(["s1", "s1", "s1", "s2", None])) for i in range(600)]
    rows += [(700, "long " * 200_000, "en", "s1"), (701, None, None, None), (702, "", "fr", "s2"), (None, "same text", "en", "s1"), (None, "same text", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("topic", "_p", "_rate", "of_topic", "measured", "p")})
    targets = spark.createDataFrame([("lang", "fr", 0.4)], "dimension string, value string, share double")
    got = mixing.mix(df, targets).toPandas()
    assert len(got) == len(rows) and got.probability.between(0, 1).all() and got.probability.max() == 1
    assert got.n_tokens.tolist() and got.set_index("doc_id").n_tokens[700] == 200_000
    assert set(got.topic[got.n_tokens == 0]) == {"none"} and len(set(got.topic)) > 2
    kept = sorted(map(str, mixing.sampled(df, targets).collect()))
    assert len(kept) == int(got.kept.sum()) and 0 < len(kept) < len(rows)
    assert mixing.sampled(df, targets).columns == df.columns
    again = mixing.sampled(df.repartition(7), targets)
    assert kept == sorted(map(str, again.collect())) and {x["topic"] for x in again.collect()} == {"clash"}
    assert mixing.mix(df.limit(0)).count() == mixing.sampled(df.limit(0), targets).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocks_cover_all_rows_once(block, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(mixing, "BLOCK", block)
    for texts in ([], ["abc"], ["abc", "d"], [None, "", "abcdefg"], ["a", None, "bcd", "efg"]):
        found = mixing._blocks(pa.array(texts, pa.string()))
        assert [k for a, b in found for k in range(a, b)] == list(range(len(texts))) and all(a < b for a, b in found)


def test_topics_are_those_of_the_texts():
    r = random.Random(10)
    pool = [[f"{k}x{i}" for i in range(30)] for k in range(3)]
    texts = [" ".join(r.choices(pool[k % 3], k=50)) for k in range(300)]
    counts = mixing.word_counts(texts)
    assert counts.sum(1).tolist() == [50] * 300 and (mixing.word_counts([texts[0].upper(), None]) == [counts[0], counts[0] * 0]).all()
    model = mixing.fit(counts[:90], ["en"] * 90, 3)
    found = model.assign(counts[90:], ["en"] * 210)
    by = [{found[i] for i in range(210) if (i + 90) % 3 == k} for k in range(3)]
    assert all(len(x) == 1 for x in by) and len(set.union(*by)) == 3
    assert mixing.fit(counts[:0], [], 3).assign(counts[:1], [None]) == ["t0"]


def test_topics_are_fitted_on_all_documents(spark):
    """More documents than any sample of 4096 had: Spark's sums give the model of all of them, whatever the partitions."""
    r = random.Random(12)
    pool = [[f"{k}y{i}" for i in range(30)] for k in range(4)]
    rows = [(i, " ".join(r.choices(pool[i % 4], k=r.randint(0, 12))), r.choice(["en", "fr", None])) for i in range(5000)] + [(5000, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = mixing.fit(mixing.word_counts([x[1] for x in rows]), [x[2] for x in rows])
    for found in (mixing.fitted_topics(docs), mixing.fitted_topics(docs.repartition(7, "text"))):
        assert (found.idf == want.idf).all() and (found.means == want.means).all() and (found.centres == want.centres).all()
    present = (mixing.word_counts([x[1] for x in rows]) > 0).sum(0)
    assert want.idf == pytest.approx(np.log(5002 / (1 + present)) + 0.1)


def test_pipeline_mixes_by_topics_of_all_documents(spark, monkeypatch):
    """More documents than any sample of 4096 had: the stage's model has seen each of them, and the stage keeps what the model of all of them gives."""
    import corpus_pipeline as p

    r = random.Random(14)
    pool = [[f"{k}z{i}" for i in range(30)] for k in range(4)]
    rows = [(i, " ".join(r.choices(pool[i % 4], k=r.randint(1, 12 + 20 * (i % 4)))), r.choice(["en", "en", "fr", None]), r.choice(["s1", "s2"])) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    stage, fitted, models = dict(p.STAGES)["source_mixing"], mixing.fitted_topics, []
    monkeypatch.setattr(mixing, "fitted_topics", lambda docs: models.append(fitted(docs)) or models[-1])
    got = sorted(x["doc_id"] for x in stage(spark, docs, "").collect())
    counts = mixing.word_counts([x[1] for x in rows])
    assert len(models) == 1 and models[0].idf == pytest.approx(np.log(5001 / (1 + (counts > 0).sum(0))) + 0.1)
    whole = mixing.fit(counts, [x[2] for x in rows])
    monkeypatch.setattr(mixing, "fitted_topics", lambda docs: whole)
    want = sorted(x["doc_id"] for x in stage(spark, docs, "").collect())
    assert got == want and 0 < len(got) < len(rows)


def test_raking_tells_its_error_and_the_kept_share(spark):
    facts = spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "source string, lang string, topic string, n_tokens long")
    off_targets = spark.createDataFrame([("source", "a", 0.9), ("lang", "x", 0.1)], "dimension string, value string, share double")
    assert all(r["marginal_error"] <= mixing.TOLERANCE for r in mixing.calibrated(facts).collect())
    with pytest.warns(RuntimeWarning, match="marginals miss"):
        off = mixing.calibrated(facts, off_targets).collect()
    assert all(r["marginal_error"] > 1 for r in off)
    mixed = spark.createDataFrame([(10, 1.0, True), (30, 0.5, False)], "n_tokens long, probability double, kept boolean")
    assert tuple(mixing.kept_share(mixed).head()) == (2, 1, 0.75, 0.625)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        before = n
        docs = p.written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        n = docs.count()
        assert docs.columns == columns and 0 < n <= before
    packed = p.STAGES[-1][1](spark, docs, "")
    assert packed.select("doc_id").distinct().count() == n


def good(text):
    """The quality rules in plain Python."""
    import unicodedata

    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    chars, dup = sum(map(len, w)), len(lines) - len(set(lines))
    return not (
        len(w) < 50 or 2 * len(inside) > len(w) or 10 * sum(c in quality.SYMBOLS for c in t) > 3 * len(w)
        or 2 * sum(unicodedata.category(c) == "Lu" for c in t) > chars or 2 * dup > t.count("\n") + 1 or not 2 * len(w) <= chars <= 20 * len(w)
    )


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(41)
    pool = ["".join(r.choices("abcdefghiklmnoprstué", k=r.randint(2, 9))) for _ in range(3000)]
    say = lambda n: " ".join(r.choices(pool, k=n))
    passage, short = say(60), say(20)
    texts = [say(r.randint(20, 200)) for _ in range(60)] + [f"{say(60)} {passage} {say(60)} {short}" for _ in range(8)]
    texts += [texts[3], texts[30].replace(" ", "  ", 1), texts[40] + " end", "SHOUT " * 80, "# $ " * 60, "a b c " * 90, "same line here\n" * 40, None, "", say(3000)]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    stages = dict(p.STAGES)
    kept = {}
    docs = spark.read.parquet(path)
    for name in [s for s, _ in p.STAGES][:4]:
        docs = p.written(stages[name](spark, docs, str(tmp_path)), name)
        kept[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    want = {i: t for i, t, *_ in rows if good(t)}
    assert kept["quality_rules"] == want and len(want) < len(rows) - 5
    root = {i: i for i in want}
    sets = {i: shingle_set(t) for i, t in want.items()}
    for a in want:
        for b in want:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    want = {i: t for i, t in want.items() if root[i] == i}
    assert kept["near_dedup"] == want and len(want) < len(kept["quality_rules"])
    want = brute_first(sorted(want.items()), suffixes.PASSAGE_WORDS)
    assert kept["suffix_dedup"] == want and sum(passage in t for t in want.values()) == 1
    chosen = kept["source_mixing"]
    assert chosen and all(want[i] == t for i, t in chosen.items())
    json = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = p.run(spark, str(tmp_path)).collect()
    ids = {i: json.encode(t, add_special_tokens=False).ids + [2] for i, t in chosen.items()}
    assert {x["doc_id"] for x in packed} == set(ids)
    for x in packed:
        part = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == x["ids_crc32"]
    assert sum(x["length"] for x in packed) == sum(map(len, ids.values()))
    tokens = sum(map(len, ids.values()))
    assert len({x["sequence_id"] for x in packed}) <= -(-tokens // 1024) + 1


def test_ids_equal_those_of_the_named_tokenizer():
    """Hostile white space, special tokens and broken-up words, in bulk."""
    import public_tokenizers
    from tokenizers import Tokenizer

    json = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(packing.VOCABULARY)
    r = random.Random(42)
    bits = [" ", "  ", "\t", "\n", "\r\n", "\u00a0", "\u2003", "\x1c", "\x0b", "don't", "we'LL", "x1y22", "é", "e\u0301", "ß", "中文", "🙂", "<|endoftext|>", "<|", "|>", "'s", "...", "_a", "Word", "1234567", "\u200b"]
    for _ in range(3000):
        text = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert np.frombuffer(encode(text), "<u4").tolist() == json.encode(text, add_special_tokens=False).ids, repr(text)


def test_empty_tables(spark):
    none = docs_of(spark, [], extra=False)
    assert suffixes.digest(none).count() == quality.judge(none).count() == wordpieces.count_pieces(none).count() == 0
    assert suffixes.remove_copies(none).count() == minhash.one_of_each(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_blocks.extract(pages).count() == urls.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).count() == 0
