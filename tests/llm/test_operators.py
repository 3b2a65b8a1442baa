"""The operators against plain Python and on the rows that break things."""

import collections
import math
import random
import sys

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartshift.llm import automaton, embeddings, html, katz, lines, mixing, quality, rollups, simhash, tokenfiles

# every null, empty and long text, ties, repeated rows, and columns named like results and like working columns
CLASH = ", n_words long, kept boolean, size long, _text string, _id long, component_id long, n_tokens long, score double"
DOCS = "doc_id long, text string, lang string, source string, n_chars long" + CLASH
EXTRA = (1, True, 2, "x", 3, 4, 5, 6.0)


def words(rng, n, letters="abcdehilnorst"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 120)
    out = [base, base, base.replace(" a ", " b ", 1), base.upper(), None, "", " \n\t ", "one", "One two", "one two"]
    out += ["line of all\n" + words(rng, 30) for _ in range(12)]
    out += [words(rng, rng.randint(1, 200)) for _ in range(12)]
    out += ["a " * 3000, "x" * 5000, "the end.\n\n  The End.\n" * 40, "<|endoftext|> é ß İ 中文   \x1c don't 12 ...", "a\x0bb\x0c c"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, "null id text here", None, None, None, *EXTRA), (None, None, None, "s1", None, *EXTRA)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def table(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_simhash_links_and_components(docs):
    rows = table(docs)
    got = simhash.near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")), "component_id")
    same([tuple(r) for r in got.collect()], brute.simhash(*zip(*rows)))
    assert simhash.near_groups(docs.where("false")).count() == 0


@pytest.mark.parametrize("large_cell", [2, 2048])
def test_fingerprint_links_find_all_at_every_cell_size(spark, large_cell):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:25]:
        for bits in (1, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), bits):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(simhash.signed(f) for f in fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "_fp long"), 3, large_cell).collect()
    mask = (1 << 64) - 1
    near = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & mask).bit_count() <= 3]
    at = {f: i for i, f in enumerate(fps)}
    found = [(at[r["a"]], at[r["b"]]) for r in links]
    assert all(((fps[i] ^ fps[j]) & mask).bit_count() <= 3 for i, j in found)

    def parts(pairs):
        roots = brute.groups(len(fps), pairs)
        return {frozenset(i for i in range(len(fps)) if roots[i] == r) for r in roots}

    assert parts(found) == parts(near)


def test_simhash_keeps_one_row_of_each_group(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r["_part"] for r in simhash.near_groups(docs).collect()}
    assert kept.count() == len(groups)
    ids = {r["doc_id"] for r in kept.collect()}
    assert 0 in ids and 1 not in ids and 2 not in ids


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_against_plain_python(docs, order):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    got = katz.score_texts(docs, held, order, block_tokens=300, part_tokens=400).collect()
    want, p, after, distinct = brute.katz(*zip(*table(docs)), order, katz.good_turing)
    key = str
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    vocabulary = {g for g in after[1][()]} | {"never seen"}
    for h in list(after[order])[:5]:
        assert sum(p(order, h, w) for w in vocabulary) == pytest.approx(1)


def test_katz_without_training_texts_or_rows(docs):
    rows = katz.score_texts(docs, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in rows} == {(0, 0, 0.0)}
    assert katz.score_texts(docs.where("false"), F.lit(False)).count() == 0


def test_katz_prefers_held_out_text_of_its_language(spark):
    rng = random.Random(2)
    lexicon = words(rng, 40).split()
    text = lambda: " ".join(lexicon[(i + rng.randint(0, 2)) % 40] for i in range(60))
    rows = [(i, text()) for i in range(200)]
    got = katz.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 10 == 0).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_bpe_encodes_and_decodes_as_the_library(docs):
    coder = brute.tokenizer("byte_bpe_50k.json")
    import public_tokenizers

    coded = automaton.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
    got = [tuple(r) for r in automaton.digests(coded, "doc_id").collect()]
    same(got, [(i, *brute.bpe(coder, t)) for i, t in table(docs)])
    assert automaton.encoded(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_automaton_on_random_text_and_every_kind_of_space():
    import public_tokenizers

    coder, own = brute.tokenizer("byte_bpe_50k.json"), automaton.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    parts = ["  ", " ", "\n", "\t", "\x1c", "\x85", "　", "the", "ing", "é", "ß", "中", "12", "'s", "'", "!!", "aaaa", "😀", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = coder.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == coder.decode(ids, skip_special_tokens=False)


def test_token_files_round_trip_in_document_order(spark, docs, tmp_path):
    import public_tokenizers

    coder = brute.tokenizer("word_bpe_49k.json")
    path = str(tmp_path / "ids")
    tokenfiles.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1, shard_ids=100)
    got = [tuple(r) for r in tokenfiles.read_tokens(spark, path).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in table(docs)), key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    want = [(i, [*coder.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in table(docs)]
    same([(r[0], r[3]) for r in got], want)
    empty = str(tmp_path / "none")
    tokenfiles.write_tokens(docs.where("false"), empty, public_tokenizers.path("word_bpe_49k.json"), 1)
    assert tokenfiles.read_tokens(spark, empty).count() == 0


def test_any_token_of_a_shard_alone():
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 1 << int(b), n) for b, n in zip((3, 8, 9, 16, 31, 1), (700, 1500, 0, 4000, 900, 5))]
    shard = tokenfiles.Shard(tokenfiles.shard_bytes(documents))
    everything = np.concatenate(documents)
    for i in rng.integers(0, len(everything), 500):
        assert shard.ids(i, i + 1).tolist() == [everything[i]]
    for k, d in enumerate(documents):
        assert shard.document(k).tolist() == d.tolist()


VECTORS = "vec_id long, embedding array<float>, label int, links long, node long, v string"


@pytest.mark.parametrize("most", [(4096, 16384), (3, 5)])
def test_embedding_links_against_all_pairs(spark, most):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        center = rng.normal(size=24)
        rows += [((center + rng.normal(size=24) * s).tolist(), i % 2) for s in (0, 0.02, 0.1, 0.3)]
    rows += [rows[0], rows[0], ([0.0] * 24, 1), (None, 1), ([], 0), ([float("nan")] * 24, 0), ([1.0, None] * 12, 0)]
    rows += [(rows[0][0], None), ([x * 3 for x in rows[0][0]], 0), (rows[0][0][:8], 0), ([float("inf")] * 24, 1)]
    rows += [(rows[0][0], 0) for _ in range(20)]
    table_ = [(i if i != 3 else None, v, c, 1, 2, "x") for i, (v, c) in enumerate(rows)]
    table_.append(table_[5])
    got = embeddings.near_vectors(spark.createDataFrame(table_, VECTORS), most=most).collect()
    used = []
    for _, v, c, *_ in table_:
        a = np.array([math.nan if x is None else x for x in v or ()], np.float32).astype(float)
        used.append(a if c is not None and len(a) and np.isfinite(a).all() and a.any() else None)

    def cosine(i, j):
        a, b = used[i], used[j]
        if a is None or b is None or len(a) != len(b) or table_[i][2] != table_[j][2]:
            return 0
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))

    pairs = [(i, j) for i in range(len(used)) for j in range(i) if cosine(i, j) >= 0.93]
    links = np.bincount(np.array(pairs).ravel(), minlength=len(used))
    ids = [r[0] for r in table_]
    part = least_ids(ids, pairs)
    same([tuple(r) for r in got], [(i, int(n), c, i is not None and i == c) for i, n, c in zip(ids, links, part)])


def least_ids(ids, pairs):
    return brute.least_id(ids, brute.groups(len(ids), pairs))


def test_embedding_recall_near_the_limit():
    rng = np.random.default_rng(5)
    index = embeddings.PolytopeIndex()
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.931 * a + math.sqrt(1 - 0.931**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    ha, hb = index.hashes(a), index.hashes(b)
    met = (embeddings.visits(ha, hb) | embeddings.visits(hb, ha)).any(axis=1)
    assert met.mean() > 0.99


def test_empty_embeddings(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_quality_on_odd_rows(docs):
    got = quality.judge(docs).collect()
    assert len(got) == docs.count() and all(r["kept"] is not None for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["n_words"] == 0 and by_id[4]["base_failed"]
    repeated = next(r for r in got if r["n_words"] == 3000)
    assert repeated["n_repeat_words"] == 3000 and repeated["base_failed"]
    assert quality.passing(docs).columns == docs.columns
    assert quality.judge(docs.where("false")).count() == 0


def test_hosts_of_bad_pages_lose_failing_pages_only(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = good + " ***" * 20
    rows = [(i, bad if i % 5 else good, "bad.example") for i in range(50)]
    rows += [(100 + i, good if i % 10 else bad, "good.example") for i in range(50)]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r["kept"]}
    assert kept == {i for i, t, _ in rows if t == good} | {r[0] for r in rows if r[2] == "good.example"}


def host_docs(spark, *hosts):
    """``(name, documents, failing documents)`` per host; a failing one fails the symbol rule only."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(good + " ***" * 20 * (i < k), name) for name, n, k in hosts for i in range(n)]
    docs = [(i, t, name) for i, (t, name) in enumerate(rows)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string")


def lost_by_host(df):
    return dict(collections.Counter(r["source"] for r in quality.judge(df).collect() if not r["kept"]))


def test_single_documents_do_not_make_a_host_bad(spark):
    assert lost_by_host(host_docs(spark, *[(f"h{i}", 1, int(i % 10 == 0)) for i in range(200)])) == {}


def test_a_host_that_differs_loses_its_failing_documents(spark):
    hosts = [("bad", 50, 40), *[(f"h{i}", 20, i % 3) for i in range(20)], *[(f"s{i}", 1, int(i == 0)) for i in range(30)]]
    assert lost_by_host(host_docs(spark, *hosts)) == {"bad": 40}


def test_failures_of_the_base_rule_make_a_host_bad(spark):
    docs = host_docs(spark, ("bad", 10, 5), *[(f"h{i}", 30, 3) for i in range(10)])
    short = spark.range(30).select((F.col("id") + 1000).alias("doc_id"), F.lit("too short").alias("text"), F.lit("bad").alias("source"))
    assert lost_by_host(docs.unionByName(short)) == {"bad": 35}


def test_the_prior_takes_sampling_for_what_it_is():
    rules = quality.HostRules()
    rng = np.random.default_rng(1)
    for n, spread, low, high in ((50, 0, 300, 1e6), (50, 20, 12, 35), (3, 20, 8, 80)):
        rates = rng.beta(0.2 * spread, 0.8 * spread, 4000) if spread else np.full(4000, 0.2)
        k = rng.binomial(n, rates)
        s = quality.strength_of(4000, 4000.0 * n, 4000.0 * n * n, float(k.sum()), float((k * k / n).sum()), rules)
        assert low <= s <= high
    assert quality.strength_of(7, 7.0, 7.0, 2.0, 2.0, rules) == 1e6  # one document each: nothing to learn
    assert quality.strength_of(7, 70.0, 700.0, 0.0, 0.0, rules) == 1e6


def test_many_shared_lines_take_linear_time(spark):
    import time

    for n, most in ((16_000, 20), (200_000, 60)):
        text = "\n".join(f"line {i % (n // 2)} of all" for i in range(n))
        docs = spark.range(10 if n < 100_000 else 1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
        start = time.time()
        got = lines.drop_frequent_lines(docs, 10 if n < 100_000 else 1).agg(F.sum("n_dropped"), F.max("kept_text")).first()
        assert got[0] == (10 * n if n < 100_000 else n) and got[1] == ""
        assert time.time() - start < most


def test_lines_are_put_together_by_position(spark):
    rows = [(i, f"shared\n{i} own\n Shared \n\nlast {i}\nSHARED", 1) for i in range(10)] + [(3, "3 other\nshared\nend", 1), (None, "shared", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _pos int")
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.drop_frequent_lines(df).collect())
    want = [(str(i), 6, 3, f"{i} own\n\nlast {i}") for i in range(10)] + [("3", 3, 1, "3 other\nend"), ("None", 1, 1, "")]
    assert got == sorted(want)


def test_lines_on_odd_rows(docs):
    got = lines.drop_frequent_lines(docs, 5).select("doc_id", "text", "n_lines", "n_dropped", "kept_text").collect()
    assert len(got) == docs.count()
    keys = {}
    clean = lambda line: brute.lower(line.strip(" \t\n\x0b\f\r"))
    for r in got:
        for line in (r["text"] or "").split("\n"):
            keys.setdefault(clean(line), set()).add(r["doc_id"])
    common = {k for k, d in keys.items() if k and len(d) >= 5}
    assert common == {"line of all"}
    for r in got:
        had = (r["text"] or "").split("\n")
        left = [x for x in had if clean(x) not in common]
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(had), len(had) - len(left), "\n".join(left))
    assert lines.drop_frequent_lines(docs.where("false")).count() == 0


def test_mix_on_odd_rows(docs):
    first = sorted(map(str, mixing.sampled(docs).collect()))
    assert first == sorted(map(str, mixing.sampled(docs.repartition(5)).collect())) and len(first) == docs.count()
    got = mixing.sampled(docs).collect()
    sums = {}
    for r in got:
        assert 0 <= r["copies"] <= 3
        s = sums.setdefault(r["source"], [0, r["target"], 0])
        s[0] += r["copies"] * r["size"]
        s[2] = max(s[2], r["size"])
    assert all(abs(taken - target) <= largest for taken, target, largest in sums.values())
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)
    assert mixing.sampled(docs.where("false")).count() == 0


def test_rollup_applies_each_batch_once(spark, rows, tmp_path):
    schema = "op string, doc_id long, source string, lang string, version string, tokens long, seq long"
    store = rollups.TokenRollup(spark, str(tmp_path / "store"))
    totals = lambda: {tuple(r) for r in store.totals().collect()}
    assert totals() == set()
    first = rows(schema, ("insert", 1, "a", "en", "v1", 10, 0), ("insert", 2, "a", "en", "v1", 5, 0), ("insert", 2, "a", "en", "v2", 7, 0),
                 ("insert", 3, None, None, "v1", 1, 0), ("insert", 3, None, None, "v1", 2, 1), ("insert", None, "a", "en", "v1", 9, 0),
                 ("insert", 4, "a", "en", "v1", None, 0), ("oops", 4, "a", "en", "v1", 4, 0))
    assert store.apply("1", first) and not store.apply("1", first)
    assert totals() == {("a", "en", "v1", 2, 15), ("a", "en", "v2", 1, 7), (None, None, "v1", 1, 2)}
    assert store.apply("2", rows(schema, ("revise", 1, "b", "en", "v1", 12, None), ("delete", 2, None, None, None, None, None),
                                 ("delete", 9, None, None, "v1", None, None)))
    assert totals() == {("b", "en", "v1", 1, 12), (None, None, "v1", 1, 2)}
    assert store.apply("3", first.where("false")) and totals() == {("b", "en", "v1", 1, 12), (None, None, "v1", 1, 2)}


CHANGES = "op string, doc_id long, source string, lang string, version string, tokens long, seq long, sign int, old_version string"


def change(op, doc, version, tokens, seq=0):
    return (op, doc, "a", "en", version, tokens, seq, 9, "clash")


def test_rollup_deletes_what_the_same_batch_put_in(spark, rows, tmp_path):
    store = rollups.TokenRollup(spark, str(tmp_path / "store"))
    store.apply("1", rows(CHANGES, change("insert", 1, "v1", 10), change("delete", 1, None, None, 1), change("insert", 2, "v1", 4, 0),
                          change("delete", 2, None, None, 1), change("insert", 2, "v2", 6, 2), change("delete", 3, "v1", None)))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v2", 1, 6)]


def test_rollup_of_two_batches_at_once_is_right_or_refused(spark, rows, tmp_path, monkeypatch):
    store = rollups.TokenRollup(spark, str(tmp_path / "store"))
    store.apply("0", rows(CHANGES, change("insert", 1, "v1", 10)))
    seen = store.state()
    other = rollups.TokenRollup(spark, store.path)
    store.apply("1", rows(CHANGES, change("revise", 1, "v1", 12)))
    monkeypatch.setattr(other, "state", lambda: seen)  # it has read before the other one was committed
    with pytest.raises(rollups.Overtaken):
        other.apply("2", rows(CHANGES, change("revise", 1, "v1", 15)))
    assert [r["n_tokens"] for r in store.totals().collect()] == [12]
    monkeypatch.undo()
    assert other.apply("2", rows(CHANGES, change("revise", 1, "v1", 15))) and not store.apply("2", rows(CHANGES, change("insert", 9, "v1", 1)))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 1, 15)]


def test_rollup_reads_a_snapshot_and_what_came_after(spark, rows, tmp_path, monkeypatch):
    store = rollups.TokenRollup(spark, str(tmp_path / "store"))
    totals = lambda: sorted(map(tuple, store.totals().collect()))
    for batch in range(4):
        store.apply(str(batch), rows(CHANGES, *[change("insert", i, f"v{batch % 2}", 10 * batch + i) for i in range(5)]))
    before, kind = totals(), rows(CHANGES).schema["doc_id"].dataType
    seen = store.state()
    store.compact(kind)
    assert totals() == before and len(store.state()[1]) == 1
    store.apply("more", rows(CHANGES, change("delete", 1, None, None)))
    assert len(store.state()[1]) == 2 and not store.apply("2", rows(CHANGES, change("insert", 7, "v1", 1)))
    want = [(s, lang, v, n - 1, tokens - {"v0": 21, "v1": 31}[v]) for s, lang, v, n, tokens in before]
    assert totals() == want
    monkeypatch.setattr(store, "state", lambda: seen)
    with pytest.raises(rollups.Overtaken):
        store.compact(kind)
    monkeypatch.undo()
    assert totals() == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-banner">We use cookies</div><div class="with-sidebar">
<article><h1>Head &lt;1&gt;</h1><p><b>One &amp; two.<br><p>Three&nbsp;four
 five</p><div class="ad">Buy</div><section id="comments"><article class="comment"><p>First!</p></article></section></article></div>
<aside>Side</aside><form><p>Mail</p></form><footer>&copy; x</footer></body></html>"""


def test_main_text_of_pages(spark):
    rng = random.Random(9)
    notice = "this site is run by friendly people who like cake a lot"
    own = [words(rng, 30) for _ in range(6)]
    pages = [(1, "http://h.example/1", PAGE, "x"), (2, None, None, "x"), (3, "no url", "", "x"), (4, "http://h.example/2", PAGE[: PAGE.index("Three")], "x")]
    pages += [(10 + i, f"http://o.example/{i}", f"<body><div>{notice}</div><p>{t}</p>", "x") for i, t in enumerate(own)]
    pages += [(20 + i, f"http://c.example/{i}", f"<p>{own[0]}</p>", "x") for i in range(4)]
    pages += [pages[0], (None, "http://h.example/1", "plain text &lt; only", "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = html.main_text(frame).collect()
    assert len(got) == len(pages)
    found = {r["page_id"]: r["text"] for r in got}
    assert found[1] == "Head <1>\nOne & two.\nThree four five"
    assert (found[2], found[3], found[None]) == ("", "", "plain text < only")
    assert found[4].startswith("Head <1>\nOne & two.")
    assert [found[10 + i] for i in range(6)] == own  # the notice repeats on the host
    assert all(found[20 + i] == own[0] for i in range(4))  # copies of one page keep their text
    assert html.main_text(frame.where("false")).count() == 0


def test_main_text_keeps_main_beside_cards_and_articles_with_comment_words(spark):
    pages = [
        "<main><p>Own text.</p><article>Card</article><nav>Menu</nav></main>",
        "<main><p>Own text.</p></main><article>Card</article>",
        '<article class="post comments-open"><p>Own text.</p><section id="discussion"><p>More.</p></section></article>',
        '<main class="comments"><p>Own text.</p><div class="no-comments">More.</div></main>',
        '<article><p>Own text.</p><ol class="comment-list"><li>First!</li></ol></article><article class="comment">Second!</article>',
        '<div id="comments"><article class="comment">First!</article></div><article class="reply-open"><p>Own text.</p></article>',
        '<article><p>Own text.</p><div class="related-posts">Card</div></article>',
        '<article><p>Own text.</p><section class="related-work"><p>More.</p></section></article>',
    ]
    want = ["Own text.\nCard", "Own text.\nCard", "Own text.\nMore.", "Own text.\nMore.", "Own text.", "Own text.", "Own text.", "Own text.\nMore."]
    rows = [(i, f"http://h{i}.example/", page) for i, page in enumerate(pages)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in sorted(got)] == want


def test_main_text_of_odd_markup(spark):
    pages = {
        'See <a title="the hidden valley">this valley</a> now': "See this valley now",
        '<section aria-label="Our hidden history"><p>Kept</p></section><p hidden>gone</p><p aria-hidden="true">gone</p><p style="color:red; DISPLAY : none">gone</p>': "Kept",
        '<article><section id="social-history"><p>One</p></section><div class="long-form"><p>Two</p></div><h2 id="navigation">Three</h2></article>': "One\nTwo\nThree",
        '<p class="promo">Buy<p>Real text one<p>Real text two': "Real text one\nReal text two",
        '<ul><li class="share">Tweet<li>First<li>Second</ul>': "First\nSecond",
        'a <span class="ad">Buy <span>now</span> cheap</span> b': "a\nb",
        '<table><tr><td class="ad">x<td>y<tr><td>z</table>': "y\nz",
        '<dl><dt class="promo">t<dd>d<dt>u</dl>': "d\nu",
        '<div class="ad"><b>one<div>two</div></b> three</div>four': "four",
        '<article><p>One <b>two <i>three</b> four</i> five</p><div class="share-buttons">x</div></article>': "One two three four five",
        '<ul class="menu"><li><ul><li>a</ul><li>b</ul><p>Text</p>': "Text",
        "<p>one<div>two</p>three</div>four": "one\ntwo\nthree\nfour",
        "<div class=ad>x</div><div class='site-header'>y</div><p>z": "z",
    }
    rows = [(i, f"http://h{i}.example/", page) for i, page in enumerate(pages)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in sorted(got)] == list(pages.values())


def test_main_text_of_long_pages_takes_linear_time(spark):
    import time

    n = 60_000
    pages = ["<b>" * n + "<h1>x</h1>" * n, "<p class=ad>x" * n + "<p>end", "<li>x" * n, "<div>" * n + "x" + "</i>" * n, "<span class=ad>" * n + "</span>" * n + "end",
             "<a href='" * n, "&amp;" * n, "<p>" + "word " * n]
    start = time.time()
    for page in pages:
        html.blocks_of(page)
    assert time.time() - start < 30
    rows = [(i, None, page) for i, page in enumerate(pages)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages)


def test_the_same_page_has_the_same_text_on_a_host_of_any_size(spark):
    page = "<article>Text {0}</article><div>Own line here {0}</div>"
    rows = [(i, f"http://{'one' if i == 0 else 'more'}.example/{i}", page.format(i)) for i in range(4)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in sorted(got)] == [f"Text {i}\nOwn line here {i}" for i in range(4)]


def test_main_text_counts_copies_once_and_drops_boilerplate_of_any_share(spark):
    rng = random.Random(4)
    notice, other = (" ".join(f"{k}{i}" for i in range(100)) for k in "nm")
    own = [" ".join(f"w{p}x{i}" for i in range(20)) for p in range(9)]
    pages = [(i, f"http://a.example/{i}", f"<div>{notice}</div><p>{own[i]}</p>") for i in range(3)]
    pages += [(10 + i, f"http://a.example/copy{i}", f"<div>{notice}</div><p>{own[3]}</p>") for i in range(3)]  # copies
    pages += [(20, "http://b.example/0", f"<div>{other}</div><p>{own[4]}</p>")] * 3  # a row three times is one page
    pages += [(30 + i, f"http://c.example/{i}", f"<div>{other}</div><p>{own[5]}</p><aside>Ad {i}</aside>") for i in range(4)]
    rng.shuffle(pages)
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    found = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(pages)
    assert [found[i] for i in range(3)] == own[:3]
    assert [found[10 + i] for i in range(3)] == [own[3]] * 3
    assert found[20] == f"{other}\n{own[4]}"
    assert [found[30 + i] for i in range(4)] == [f"{other}\n{own[5]}"] * 4


def test_main_text_decides_beside_articles_on_two_pages_and_on_short_blocks(spark):
    notice = " ".join(f"n{i}" for i in range(12))
    pages = [(i, f"http://a.example/{i}", f"<div>{notice}</div><article>Text {i}</article><div>Own line {i}</div>") for i in range(3)]
    pages += [(10 + i, f"http://b.example/{i}", f"<div>{notice}</div><p>Own line {i}</p>") for i in range(2)]
    pages += [(20 + i, f"http://c.example/{i}", f"<div>Read more</div><p>Own line {i}</p>") for i in range(3)]
    pages += [(30, "http://d.example/", f"<div>{notice}</div><article>Text</article>"), (31, "http://e.example/", f"<div>{notice}</div>")]
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    found = {r["page_id"]: r["text"] for r in got}
    assert [found[i] for i in range(3)] == [f"Text {i}\nOwn line {i}" for i in range(3)]
    assert [found[10 + i] for i in range(2)] == [f"Own line {i}" for i in range(2)]
    assert [found[20 + i] for i in range(3)] == [f"Own line {i}" for i in range(3)]
    assert (found[30], found[31]) == (f"{notice}\nText", notice)  # one rule: what does not repeat stays


def test_suffix_array_in_ranges_agrees_with_counting(spark):
    rng = random.Random(8)
    rules = html.Boilerplate(depth=2)
    passages = [[rng.choice("abc") for _ in range(5)] for _ in range(4)]
    rows = []
    for i in range(120):
        host = f"h{i % 3}"
        line = "\n".join(" ".join(rng.choice([*passages, [f"w{i}"], [rng.choice("abc")]])) for _ in range(4))
        rows.append((host, 3, i // 2 if i % 5 else 7, i, line))
    where = collections.defaultdict(set)
    for host, _, same, _, line in rows:
        for start, _, _ in html.suffixes(line.split("\n"), 2):
            where[host, start].add(same)
    want = {}
    for host, _, _, stream, line in rows:
        starts = {html.digest(s) for s, _, _ in html.suffixes(line.split("\n"), 2) if len(where[host, s]) >= 3}
        if starts:
            want[stream] = starts
    streams = spark.createDataFrame(rows, "host string, need long, same long, stream long, line string")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["stream"]: set(r["covered"]) for r in html.repeats(streams, rules).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_streams_of_pages_without_unmarked_blocks_are_sorted_too(spark, monkeypatch):
    rows = [
        (i, f"http://{'one' if i == 9 else 'more'}.example/{i}", f"<nav>Home Menu</nav><article>Text {i}</article>")
        for i in range(10)
    ]
    sorted_ones, repeats = [], html.repeats

    def seen(streams, rules):
        sorted_ones.extend(streams.collect())
        covered = repeats(streams, rules)
        sorted_ones.append(covered.collect())
        return covered

    monkeypatch.setattr(html, "repeats", seen)
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    *streams, covered = sorted_ones
    assert [(r["host"], r["need"], r["line"]) for r in streams] == [("more.example", 3, "Home Menu")] * 3
    assert [r["covered"] for r in covered] == [[html.digest(html.END + "Home Menu")]]
    assert sorted(r["text"] for r in got) == [f"Text {i}" for i in range(10)]


def test_katz_messages_say_once_what_a_part_needs_of_a_word(spark):
    rng = np.random.default_rng(5)
    words = [f"w{int(i)}" for i in np.exp(rng.random(120_000) * np.log(20_000))]
    texts = [(i, " ".join(words[i * 400 : (i + 1) * 400])) for i in range(300)]
    docs = spark.createDataFrame(texts, "_id long, _text string").withColumn("_held", F.lit(False))
    blocks = katz.text_blocks(docs.coalesce(1)).localCheckpoint()

    def sent(parts):
        total = katz.stored(katz.word_totals(katz.word_requests(blocks, parts), 1 << 40, parts))
        step = katz.Step(katz.read_order(total.where("block < 0").collect()), {}, total)
        return katz.gram_requests(blocks, [step], {}, parts, True).agg(F.sum(F.length("sent"))).first()[0]

    pairs = len({p for _, text in texts for p in zip(text.split(), text.split()[1:])})
    assert sent(40) < 2.6 * pairs  # bytes; 3.6 or more if every message lists what its pairs need


def test_kept_pieces_are_bounded_and_common_ones_stay(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(automaton, "WORDS_KEPT", 50)
    own = automaton.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    asked, tokens = collections.Counter(), own.automaton.tokens

    def counted(word):
        asked[word] += 1
        return tokens(word)

    own.automaton.tokens = counted
    for i in range(2000):
        own.encode(f"common word{i:04d}x common")
    own.encode("y" * 5000)
    assert asked[b" common"] == asked[b"common"] == 1
    for kept in (own, own.runs, own.automaton.table):
        assert len(kept) + len(kept.older) <= 100
    assert max(map(len, own)) < 100


def test_bpe_of_rare_words_takes_few_calls():
    import public_tokenizers

    own = automaton.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    parts = ["an", "er", "sch", "heit", "tion", "re", "th", "ha", "ou", "wh", "in", "ly"]
    rare = {"".join(rng.choice(parts) for _ in range(rng.randint(3, 5))) for _ in range(2000)}
    text, calls = "the " + " ".join(sorted(rare)), collections.Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        own.encode(text)
    finally:
        sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < 70 * len(rare)  # 88 each when every length was looked up


def test_bpe_of_many_texts_together_is_that_of_each(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, rng = brute.tokenizer("byte_bpe_50k.json"), random.Random(9)
    parts = [" ", " ", " ", "  ", "\n", " \n", "\x1c", "the", "ing", "é", "12", "'s", "!!", "😀", "<|endoftext|>", "y" * 50]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    want = [coder.encode(t, add_special_tokens=False).ids for t in texts]
    for kept, together in ((7, 1), (7, 300), (7, 1 << 20), (150_000, 300)):
        monkeypatch.setattr(automaton, "WORDS_KEPT", kept)
        monkeypatch.setattr(automaton, "TOGETHER", together)
        own = automaton.Codec(path)
        assert [np.frombuffer(i, "<u4").tolist() for i in own.encode_all(texts)] == want
        assert len(own.runs) + len(own.runs.older) <= 2 * kept
