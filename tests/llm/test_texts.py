"""The text operators against brute force, round trips, held-out rows and awkward tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.llm import bpe, chat, common, cotraining, decontam, labelled, langid, neardup, quality_rules, queries, sharding, suffixes, toxicity
from locusframe.llm.components import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(texts), schema)


def prose(seed, n, words=300):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(words)]
    return [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(30, 90))) for _ in range(n)]


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, "word " * 30000), (6, "a" * 60000), (7, "tie"), (8, "tie"), (8, "tie"), (None, "no key"), (9, "é日本😀́")]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD)


def wide(df):
    """Columns whose names the operators use inside."""
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("doc", "copy", "spans", "_row", "node", "root", "bands", "shard", "score", "n_words", "label", "kept"))])


# sharding


def brute_shard(key, n):
    draw = lambda i: (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    return max(range(n), key=lambda i: (draw(i), -i))


def test_sharding(spark, awkward):
    out = sharding.shard(awkward, [1.0] * 5, grown=1.0, parts=3).collect()
    assert len(out) == len(AWKWARD)
    texts = {(k, zlib.crc32((t or "").encode())): len((t or "").encode()) + 8 for k, t in AWKWARD}
    for r in out:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == brute_shard(key, 5) and r["grown_shard"] == brute_shard(key, 6)
        assert r["grown_shard"] in (r["shard"], 5)
        assert texts[r["doc_id"], r["text_crc32"]] == r["size"]
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.shard(awkward.limit(0), [1.0]).count() == 0
    assert sharding.shard(wide(awkward), [1.0, 1.0]).count() == len(AWKWARD)


def test_weighted_shards(spark):
    out = sharding.shard(docs(spark, [(i, "x") for i in range(4000)]), [3.0, 1.0, 0.0]).groupBy("shard").count().collect()
    sizes = {r["shard"]: r["count"] for r in out}
    assert set(sizes) == {0, 1} and 0.7 < sizes[0] / 4000 < 0.8
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit("x"), [0.0])


# chat


def test_best_branch_of_a_tree(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b <|end|>\n\\b", 2.0), (1, 4, 3, "user", "c", 0.0), (1, 5, 2, "user", "d", 1.0), (2, 1, None, "user", "only", 0.0)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    out = chat.format_trees(df, best=2).select("conv_id", "leaf", "rank", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    got = {(r["conv_id"], r["rank"]): ([x["text"] for x in r["t"]], r["loss"]) for r in out}
    assert got == {(1, 1): (["q", "b <|end|>\n\\b", "c"], "b <|end|>\n\\b"), (1, 2): (["q", "a", "d"], "a"), (2, 1): (["only"], "")}


def test_long_and_awkward_conversations(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i} <|turn|>\\p<\\p") for i in range(37)]
    turns += [(2, None, None, None), (2, 1, "a\nb<|end|>\n", "x"), (2, 1, "a\nb<|end|>\n", "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.reply_tree(df)).select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    got = {r["conv_id"]: ([tuple(x) for x in r["t"]], r["loss"]) for r in out}
    assert got[1][0] == [(r, t) for _, _, r, t in turns[:37]]
    assert got[1][1] == "".join(t for _, _, r, t in turns[:37] if r == "assistant")
    assert got[2][0] == [("", ""), ("a\nb<|end|>\n", "x"), ("a\nb<|end|>\n", "x")]
    assert got[None][0] == [("user", "n")]
    assert chat.format_trees(chat.reply_tree(df.limit(0))).count() == 0


# quality rules


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_measures(spark):
    texts = [(i, t) for i, t in enumerate([None, "", "a b", "x|y #", "l\nl\n \nl\nm", *prose(1, 5), " ".join(prose(2, 1)[0].split() * 2), "w " * 50, "é b\x0bc", "a b c d e f g h i a b c d e f g h j"])]
    out = quality_rules.text_measures(docs(spark, texts)).collect()
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(texts[r["doc_id"]][1])


def test_judged_by_their_group(spark, awkward):
    clean = [(i, t, "en", "a", 0) for i, t in enumerate(prose(3, 150))]
    odd = [(900, prose(4, 1)[0].replace(" ", "*** "), "en", "a", 0), (901, None, None, None, 0), (902, "", "en", None, 0)]
    out = {r["doc_id"]: r for r in quality_rules.judge(wide(docs(spark, clean + odd, DOC))).collect()}
    assert sum(out[i]["kept"] for i in range(150)) >= 145  # a rule rejects 3 % at most, and only word lengths differ
    assert not out[900]["kept"] and not out[900]["base_failed"] and out[901]["base_failed"] and out[902]["base_failed"]
    assert not out[901]["kept"] and not out[902]["kept"]
    assert quality_rules.judge(docs(spark, [], DOC)).count() == 0
    odd = {r["doc_id"]: r for r in quality_rules.judge(awkward.selectExpr("*", "'x' lang", "'y' source")).where("doc_id IS NOT NULL").collect()}
    assert all(odd[k]["base_failed"] for k, t in AWKWARD if k and len((t or "").split()) < 20) and odd[5]["base_failed"] and odd[5]["n_repeat_words"] == 30000


def test_every_threshold_follows_its_group(spark):
    """Two sources of one language that differ in all four metrics; what is common in one is rejected in the other."""
    body = prose(41, 400)
    marked = [t.replace(" ", "# ", 4) + "\n" + "\n".join([" ".join(t.split()[:8])] * 2) + "\n" + "longwordsinside " * 3 for t in body[200:]]
    rows = [(i, t, "en", "plain", 0) for i, t in enumerate(body[:200])] + [(500 + i, t, "en", "marked", 0) for i, t in enumerate(marked)] + [(900, marked[0], "en", "plain", 0)]
    measured = quality_rules.text_measures(docs(spark, rows, DOC)).drop("text")
    cuts = {r["source"]: r for r in quality_rules.thresholds(quality_rules.sketches(measured)).collect()}
    assert all(cuts["marked"][f"max_{m}"] > cuts["plain"][f"max_{m}"] for m in quality_rules.METRICS), cuts
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs(spark, rows, DOC)).collect()}
    assert not kept[900] and sum(kept[500 + i] for i in range(200)) > 150


# byte-level BPE

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_as_the_library_does(spark):
    import tiktoken

    with open(PATH, "rb") as f:
        vocabulary = bpe.Vocabulary(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    draw = random.Random(5)
    texts = AWKWARD + [(100 + i, "".join(draw.choice("abcdeé \n1'!日") for _ in range(400))) for i in range(40)] + [(200, "ab" * 3000), (201, "<|endoftext|>"), (202, "x1 " * 400_000)]
    encoded = bpe.encode(wide(docs(spark, texts)), PATH, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, PATH).collect()
    want = Counter((k, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for k, t in texts)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in back) == want
    both = bpe.encode(docs(spark, texts[:5]), PATH, public_tokenizers.PATTERN, back=True).collect()
    assert all(bytes(r["decoded"]) == (dict(texts)[r["doc_id"]] or "").encode() for r in both)
    assert bpe.encode(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


# language


def brute_kneser_ney(text):
    """P(c | three characters before) by the textbook, from dictionaries."""
    import re

    t = "   " + re.sub("[^a-z]+", " ", text.lower()).strip() + " "
    levels = {4: Counter(t[i : i + 4] for i in range(len(t) - 3))}
    for w in (3, 2, 1):
        levels[w] = Counter(g[1:] for g in levels[w + 1])
    discounts = {}
    for w, c in levels.items():
        n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        discounts[w] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(g):
        w = len(g)
        if not w:
            return 1 / (len(levels[1]) + 1)
        mine = {k: v for k, v in levels[w].items() if k[:-1] == g[:-1]}
        if not mine:
            return p(g[1:])
        total = sum(mine.values())
        return max(mine.get(g, 0) - discounts[w], 0) / total + discounts[w] * len(mine) / total * p(g[1:])

    return p, levels


def test_kneser_ney_against_dictionaries():
    text = "Abra cadabra, the banana bandana; a cabana band and a barbican"
    packed, sizes, has = langid.grams([text, "", "12 --", "x"])
    assert has.tolist() == [True, False, False, True]
    own = packed[: sizes[0]]
    model = langid.Model(*np.unique(own, return_counts=True))
    p, levels = brute_kneser_ney(text)
    tests = [*levels[4], *[g[:3] + c for g in list(levels[4])[::5] for c in "abx "], "zzza", "qqqq"]
    pack = lambda g: sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g))
    got = np.exp(model.log_probability(np.array([pack(g) for g in tests], np.uint64)))
    assert got == pytest.approx([p(g) for g in tests], rel=1e-9)
    letters = [c for (c,) in levels[1]]
    assert sum(p("ban" + c) for c in letters) + 0 <= 1 + 1e-9


def test_language(spark, awkward):
    en, de = ["the quick brown fox and the dog"] * 3, ["der schnelle braune fuchs und der hund"] * 3
    rows = [(i, t, "en") for i, t in enumerate(en)] + [(10 + i, t, "de") for i, t in enumerate(de)] + [(20, "zzz", None)]
    models = langid.fit(docs(spark, rows, "doc_id long, text string, lang string"))
    assert list(models) == ["de", "en"]
    test = docs(spark, [*AWKWARD, (50, "the dog and the fox"), (51, "der hund und der fuchs"), (52, "123 !")])
    out = {r["doc_id"]: r for r in langid.identify(wide(test), models).collect()}
    assert (out[50]["lang_pred"], out[51]["lang_pred"]) == ("en", "de")
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (1, 2, 3, 52))
    assert langid.fit(docs(spark, [], "doc_id long, text string, lang string")) == {}
    assert {r["lang_pred"] for r in langid.identify(awkward, {}).collect()} == {"und"}
    assert langid.identify(awkward.limit(0), models).count() == 0
    found = langid.identify(docs(spark, rows, "doc_id long, text string, lang string"), models, keep=("lang",))
    scored = langid.calibrated(found, F.lit(True)).collect()
    assert len(scored) == len(rows) and all(r["score"] > 0.9 for r in scored if r["doc_id"] < 20)
    assert langid.calibrated(found.limit(0), F.lit(True)).count() == 0


# benchmark


def test_templates_and_slots(spark, awkward):
    item = "Yesterday the farmer Miller sold 12 kg of apples and 30 kg of pears to his neighbour Jones for 45 dollars in total"
    texts = [
        (1, f"Some start here. {item}. And an end."),
        (2, "intro. " + item.replace("Miller", "Smith").replace("12", "77").replace("45", "9") + " outro"),
        (3, item.replace("30 kg", "12 kg")),  # one value for two is consistent
        (4, "the farmer sold apples and pears to his neighbour"),
        (5, " | ".join(item.upper().split())),
        (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
    ]
    bench = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (4, "1 2 3 4 5 6 7 8 9 10"), (5, "tiny item of five")], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.contaminated(wide(docs(spark, texts)), bench).collect()}
    assert set(out) == {1, 2, 3, 5, 6}  # 5 and 6 hold the words as they stand
    assert not out[1]["reparameterised"] and out[2]["reparameterised"]
    question = "Ask {} what {} gave to Paul before {} left the small town where {} was born and {} went to school"
    twice = spark.createDataFrame([(1, question.format(*["Anna"] * 5))], "item_id long, text string")
    changed = [(1, question.format(*["Berta"] * 5)), (2, question.format("Berta", "Clara", "Doris", "Emma", "Frida"))]
    found = [r["doc_id"] for r in decontam.contaminated(docs(spark, changed), twice).collect()]
    assert found == [1]
    assert decontam.contaminated(awkward, bench).count() == 0
    assert decontam.clean(wide(docs(spark, texts)), bench).count() == len(texts) - len(out)
    assert decontam.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_passages_with_an_edit_and_short_items(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    item = " ".join(words)
    counted = "sold 12 crates of ripe plums to the old harbour market before noon and kept 12 back for those who came late that day"
    bench = spark.createDataFrame([(1, item), (2, "tiny item of five words"), (3, "Paris London Rome Berlin Madrid"), (4, "one two"), (5, counted)], "item_id long, text string")
    rows = [
        (1, "so " + " ".join(words[:10]) + " extra " + " ".join(words[10:]) + " end"),  # a word put in
        (2, "so " + " ".join(words[:9]) + " " + " ".join(words[10:])),  # a word left out
        (3, "so " + " ".join(words[:9]) + " and then something else"),
        (4, "there is a tiny item of five words here"),
        (5, "a tiny item of six words"),
        (6, "we saw Paris London Rome Berlin Madrid in a week"),
        (7, "one two"),
        (8, counted.replace("kept 12", "kept 40")),  # 14 words as they stand, then a number that contradicts an earlier one
        (None, item),
        (None, "nothing here"),
        (9, item), (9, "nothing"), (9, item),
        (10, ("filler " * 200_000) + item),
    ]
    out = {r["doc_id"]: r for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    assert set(out) == {1, 2, 4, 6, 8, 9, 10, None}
    assert out[1]["matched_words"] == 20 and out[2]["matched_words"] == 19 and out[10]["items"] == [1] and out[8]["matched_words"] >= 14
    assert decontam.contaminated(docs(spark, rows).limit(0), bench).count() == 0
    assert [r["doc_id"] for r in decontam.clean(docs(spark, rows), bench).orderBy("doc_id").collect()] == [3, 5, 7]


# near duplicates


def edited(text, n, seed):
    draw, words = random.Random(seed), text.split()
    for i in draw.sample(range(len(words)), n):
        words[i] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def weighted(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def shingle_counts(t):
    w = t.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def test_classes(spark):
    base = [" ".join(prose(50 + i, 3)) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        rows += [(100 + 10 * i + k, edited(t, k, k)) for k in range(4)]
    rows += [(1000, None), (1001, ""), (1002, "  "), (1003, "tiny"), (1004, "tiny"), (1005, "Tiny"), (1006, "other"), (None, base[0])]
    out = {r["doc_id"]: r["class_id"] for r in neardup.classes(wide(docs(spark, rows))).collect() if r["doc_id"] is not None}
    texts = {i: shingle_counts(t or "") for i, t in rows if i is not None}
    names = list(texts)
    for x in names:
        for y in names:
            if x < y and texts[x] and weighted(texts[x], texts[y]) >= 0.83:
                assert out[x] == out[y], (x, y)
            if x < y and out[x] == out[y] and texts[x]:
                assert x // 100 and y // 100 or weighted(texts[x], texts[y]) > 0.6
    assert out[1000] == out[1001] == 1000 and out[1002] == 1002
    assert out[1003] == out[1004] == out[1005] == 1003 and out[1006] == 1006
    assert neardup.classes(docs(spark, [])).count() == 0
    kept = {r["doc_id"] for r in neardup.keep_first(wide(docs(spark, rows))).collect()}
    assert kept == {k for k, v in out.items() if k == v} | {None}


def test_consistent_samples_follow_weighted_similarity():
    draw = np.random.default_rng(1)
    h = common.mix(np.arange(1, 800, dtype=np.uint64))
    w = draw.choice([1.0, 2.0, 3.5], len(h))
    a, b = slice(0, 700), slice(100, 799)
    order = lambda s: (np.sort(h[s]), w[s][np.argsort(h[s])])
    s = neardup.Sampler()
    same = np.mean(s(*order(a)) == s(*order(b)))
    true = w[100:700].sum() / w.sum()
    assert abs(same - true) < 0.2


@pytest.mark.parametrize("block", [1000, 250_000])
def test_large_buckets_are_finished(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    base = " ".join(prose(9, 4))
    rows = [(i, edited(base, 1, i)) for i in range(30)]
    assert {r["class_id"] for r in neardup.classes(docs(spark, rows)).collect()} == {0}


def test_repeated_and_null_keys_and_long_texts(spark):
    draw = random.Random(6)
    a, b, c = (" ".join(f"{k}{draw.randrange(10**6)}" for _ in range(200)) for k in "xyz")
    near = lambda t: " ".join(["changed", *t.split()[1:]])
    long_text = " ".join(f"w{draw.randrange(10**5)}" for _ in range(60_000))
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (None, near(c)), (None, "alone here"), (5, long_text), (6, near(long_text)), (7, "word " * 50_000), (8, "word " * 50_010)]
    out = {(r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(docs(spark, rows)).collect()}
    assert out == {(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 2), (None, 4, 2), (None, None, 1), (5, 5, 2), (6, 5, 2), (7, 7, 2), (8, 7, 2)}
    with pytest.raises(TypeError):
        neardup.classes(docs(spark, [("a", "x")], "doc_id string, text string"))


def test_no_link_is_lost_in_large_mixed_buckets(spark):
    """One boilerplate with two to five edits in each of 300 copies: buckets hold most of them, and few pairs reach 0.8."""
    draw, n, words = random.Random(17), 300, 200
    rows, masks = [], np.ones((n, words - 4), np.int64)
    for i in range(n):
        own = [f"w{k}" for k in range(words)]
        for k in draw.sample(range(words), draw.randint(2, 5)):
            own[k] = f"own{i}x{k}"
            masks[i, max(k - 4, 0) : k + 1] = 0
        rows.append((i, " ".join(own)))
    idf = lambda df: 1 + neardup.RISE * np.log((1 + n) / (1 + df)) / np.log(1 + n)
    weights = idf(masks.sum(axis=0))
    shared, whole = (masks * weights) @ masks.T, masks @ weights + (1 - masks).sum(axis=1) * idf(1)
    alike = shared >= 0.8 * (whole[:, None] + whole - shared)
    found = np.array([r["class_id"] for r in neardup.classes(docs(spark, rows)).orderBy("doc_id").collect()])
    x, y = np.nonzero(alike)
    assert 100 < (len(x) - n) / 2 < 10_000 and (found[x] == found[y]).all()


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), common.Work(spark)).collect()}
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long"), common.Work(spark), "none").count() == 0


# repeated bytes


def brute_removal(rows):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, x in order:
        b = (x or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                covered[s : s + 100] = b"\1" * 100
            else:
                seen[b[s : s + 100]] = 1
        runs = sum(1 for k in range(len(covered)) if covered[k] and (not k or not covered[k - 1]))
        out[i] = (len(b), sum(covered), runs, bytes(c for c, m in zip(b, covered) if not m))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"batches": 1}, {"batches": 5, "hot": 10**9}])
def test_removal(spark, options):
    draw = random.Random(2)
    letters = lambda n, k="abc": "".join(draw.choice(k) for _ in range(n))
    base = letters(700)
    rows = [(0, "a" * 350), (1, "a" * 120), (2, base), (3, "x" + base[:300] + "yy" + base[250:]), (4, ""), (5, None), (6, base + base), (7, "é" * 200), (8, "ab" * 400), (9, "ab" * 90 + base[100:260] + "c"), (None, base[:150])]
    rows += [(10 + i, letters(60, "ab") + base[200:460] + letters(60, "ab")) for i in range(40)]
    out = suffixes.deduplicate(wide(docs(spark, rows)), **options).collect()
    want = brute_removal(rows)
    for r in out:
        spans = r["spans"]
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in spans), len(spans), bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]
    assert len(out) == len(rows)


def test_removal_of_long_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    draw = random.Random(4)
    long_text = "".join(draw.choice("abcdefgh ") for _ in range(7000))
    rows = [(1, long_text), (2, long_text[3000:6500]), (3, "q" * 3000)]
    want = brute_removal(rows)
    for r in suffixes.deduplicate(docs(spark, rows)).collect():
        assert bytes(r["kept"]) == want[r["doc_id"]][3]
    twice = suffixes.deduplicate(docs(spark, [(1, long_text), (1, long_text), (1, None), (2, long_text)])).collect()
    assert sorted(len(r["kept"]) for r in twice) == [0, 0, 7000, 7000]
    assert suffixes.deduplicate(docs(spark, [])).count() == 0
    text = suffixes.deduplicate(docs(spark, [(1, "é" * 90), (2, "x" + "é" * 90)]), as_text=True).collect()
    assert {r["doc_id"]: r["kept"] for r in text}[1] == "é" * 20 or all(isinstance(r["kept"], str) for r in text)


# classifiers


def quality_rows(n=400):
    good, rows, marks = prose(20, n), [], []
    for i, t in enumerate(good):
        poor = i % 3 == 0
        rows.append((i, (" ".join(w + "$%&" for w in t.split()) if i % 2 else (t.split()[0] + " ") * 60) if poor else t, "en", f"s{i % 5}" if not poor else "bad", len(t)))
        if i % 4:
            marks.append((i, 0 if poor else 1))
    return rows, marks


def test_cotraining(spark, awkward):
    rows, marks = quality_rows()
    d, l = docs(spark, rows, DOC), docs(spark, marks, "doc_id long, quality int")
    pool = cotraining.Pool(d.unionByName(d), l, common.Work(spark))
    assert pool.table().count() == len({r[1:] for r in rows if r[0] % 4 == 0})  # every row without a label, copies once
    model = cotraining.fit(d, l, per_class=150)
    assert sum(map(sum, model.shared)) > 0
    out = {r["doc_id"]: r["score"] for r in cotraining.score(wide(d).drop("score"), model, keep=("doc_id",)).collect()}
    assert sum((out[i] >= 0.5) == (i % 3 != 0) for i in out) / len(out) > 0.97
    odd = awkward.selectExpr("*", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    assert cotraining.score(odd, model).count() == len(AWKWARD)
    none = cotraining.fit(d, l.where("quality = 1"))
    assert {r["score"] for r in cotraining.score(d, none).select("score").collect()} == {1.0}
    assert cotraining.score(d.limit(0), model).count() == 0


def test_gradients():
    draw = np.random.default_rng(2)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    counts = draw.integers(1, 5, 9)
    x = toxicity.Inputs(draw.normal(size=(9, toxicity.ODDS)), draw.integers(0, 4, 9), draw.integers(0, 4, counts.sum()), counts)
    ids = draw.integers(0, 9, (5, toxicity.WINDOW))
    full = np.arange(toxicity.WINDOW) < draw.integers(1, 7, 5)[:, None]
    ids = np.where(full, ids, -1)
    y = np.array([0, 1, 1, 0, 1.0])

    def loss():
        p = toxicity._sigmoid(net.logits(net.project(x), np.where(ids < 0, 9, ids), full))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(x, ids, full, y)
    assert np.abs(g["words"][:4]).max() > 0 and np.abs(g["grams"][:4]).max() > 0
    for name in net.p:
        at = tuple(draw.integers(0, 4 if name in ("words", "grams") and not k else s) for k, s in enumerate(net.p[name].shape))
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-4), name


def test_the_network_learns_its_embeddings():
    draw = np.random.default_rng(4)
    bad, n = 5, 60  # the first words are bad; no log-odds say so
    x = toxicity.Inputs(np.zeros((n, toxicity.ODDS), np.float32), np.arange(n), np.arange(100, 100 + n), np.ones(n, int))
    ids = draw.integers(bad, n, (1200, toxicity.WINDOW))
    y = (np.arange(1200) % 2).astype(np.float32)
    ids[y == 1, draw.integers(0, toxicity.WINDOW, 600)] = draw.integers(0, bad, 600)
    full = np.ones(ids.shape, bool)
    net = toxicity.Network()
    net.fit(x, ids[:1000], full[:1000], y[:1000], epochs=60)
    assert ((net.logits(net.project(x), ids[1000:], full[1000:]) > 0) == (y[1000:] == 1)).mean() > 0.95


def test_windows_overlap_and_cover():
    begin, length, row = toxicity.windows(np.array([0, 1, 32, 33, 100]))
    assert row.tolist() == [1, 2, 3, 3, 4, 4, 4, 4, 4, 4][: len(row)] and set(row) == {1, 2, 3, 4}
    for r, n, first in ((1, 1, 0), (2, 32, 1), (3, 33, 33), (4, 100, 66)):
        words = set()
        for b, k in zip(begin[row == r], length[row == r]):
            words.update(range(b, b + k))
        assert words == set(range(first, first + n))


def test_toxicity(spark, awkward):
    draw = random.Random(8)
    rows, marks = [], []
    for i, t in enumerate(prose(30, 500)):
        toxic = i % 4 == 0
        words = t.split()
        for _ in range(3 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["nastyword", "nastyone", "nastyhead"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    d, l = docs(spark, rows), docs(spark, marks, "doc_id long, toxic int")
    model = toxicity.fit(d, l)
    assert pytest.approx(float(model.scores(pa.array(["x"]))[0])) == float(model.scores(pa.array(["x"]))[0])
    test = docs(spark, [*rows, *[(10_000 + k if k else None, t) for k, t in AWKWARD], (20_000, prose(31, 1)[0] + " nastyface"), (20_001, prose(32, 1)[0])])
    out = {r["doc_id"]: r["score"] for r in toxicity.score(wide(test).drop("score"), model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i] >= 0.5) == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert out[20_000] > out[20_001] and out[10_001] < 0.5 and out[10_002] < 0.5
    assert all(0 <= s <= 1 for s in out.values())
    nothing = toxicity.fit(d, l.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(awkward, nothing).collect()} == {0.0}
    long_text = " ".join(prose(33, 1)[0] for _ in range(9000)) + " nastyword nastyword"
    a, b = toxicity.Words(*common.text_bytes(pa.array([long_text]))), model._long(np.frombuffer(long_text.encode(), np.uint8))
    assert model._highest(a, (model.words, model.grams))[0] == pytest.approx(b[0], abs=1e-4)


def test_sample_is_bounded_and_held_out(spark):
    d = docs(spark, [(i, "t") for i in range(200)])
    l = docs(spark, [(i, i % 2) for i in range(200)] + [(0, 1), (None, 1)], "doc_id long, y int")
    out = labelled.sample(d, l, "y", 30, ["text"]).collect()
    assert Counter(r["label"] for r in out) == {0: 30, 1: 30}
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] for r in out)
    repeated = docs(spark, [(i % 4, f"t{i}") for i in range(200)])
    assert labelled.sample(repeated, l, "y", 1, ["text"]).count() <= 2


# whole queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_with_sql(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def table_texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_query_5_against_brute_force(spark):
    want = brute_removal(list(table_texts(spark).items()))
    for r in queries.QUERIES["op5_suffix_dedup"](spark, SF).collect():
        a, b, c, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (a, b, c, hashlib.sha256(kept).hexdigest())


def test_query_4_against_the_library(spark):
    import tiktoken

    with open(PATH, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(f.read()).ranks, special_tokens={})
    texts = table_texts(spark)
    for r in queries.QUERIES["op4_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest, hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_query_2_against_brute_force(spark):
    counts = {i: shingle_counts(t) for i, t in table_texts(spark).items()}
    got = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op2_minhash_neardup"](spark, SF).collect()}
    for x in counts:
        for y in counts:
            if x < y:
                s = weighted(counts[x], counts[y])
                assert got[x] == got[y] if s >= 0.83 else True
    links = [(x, y) for x in counts for y in counts if x < y and got[x] == got[y]]
    for x, y in links:  # every class hangs together by links of 0.8 or more
        assert any(weighted(counts[x], counts[z]) >= 0.8 or counts[x] == counts[z] for z in counts if z != x and got[z] == got[x]), (x, y)


def test_query_7_against_brute_force(spark):
    import re

    words = lambda t: re.findall(r"\w+", t.lower())
    grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    items = [grams(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    every = set().union(*items)
    want = {i for i, t in table_texts(spark).items() if grams(words(t)) & every}
    assert {r["doc_id"] for r in queries.QUERIES["op7_decontamination"](spark, SF).collect()} == want


def test_queries_6_and_10(spark):
    n = len(table_texts(spark))
    assert queries.QUERIES["op6_sharding"](spark, SF).count() == n
    out = queries.QUERIES["op10_langid"](spark, SF).toPandas()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = out[out.held_out]
    assert len(out) == n and (held.doc_id.map(lang) == held.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    shards = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in queries.QUERIES["op6_sharding"](spark, SF).collect()}
    assert shards == {i: (brute_shard(i, 24), brute_shard(i, 25)) for i in shards}


def test_queries_1_and_3(spark):
    marks = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    a = queries.QUERIES["op1_quality_cotraining"](spark, SF).toPandas()
    a = a[a.doc_id.isin(marks) & a.held_out]
    assert len(a) and (a.doc_id.map(lambda i: marks[i]["quality"]) == a.predicted).mean() > 0.85
    b = queries.QUERIES["op3_toxicity"](spark, SF).toPandas()
    assert len(b) == len(table_texts(spark)) and b.score.between(0, 1).all()
    b = b[b.doc_id.isin(marks) & b.held_out]
    assert len(b) and (b.doc_id.map(lambda i: marks[i]["toxic"]) == b.predicted).mean() > 0.8
