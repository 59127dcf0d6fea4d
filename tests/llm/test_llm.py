"""Each operator against a brute-force version, and its edges: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import check  # noqa: E402
from sensorloom.llm import ann, bpe, jaccard, license, mixing, passages, quality, queries, rules, simhash, substring, suffix, url_filter  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars int, key long, doc string, run int, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}x{i % 13}" for i in range(60_000))
BASE = " ".join(f"alpha{i}" for i in range(90))


def frame(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", 0, 1, "x", 2, "y") for n, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def edges(spark):
    texts = [None, "", "   \n\t ", "one", BASE, BASE, BASE.replace("alpha40 ", "other "), LONG, "a" * 5000, "é ü ß\u2028x " * 40, "x " * 300, BASE, None]
    return texts, frame(spark, texts, [*range(10), None, None, None])


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


# 1 URL filters -------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "no scheme", "https://EXAMPLE.net/en/1?x", "http://a.b.example.com/de/", "http://badexample.com/de/x", "http://x.org/fr/", "http://x.org/fr", "http://net", "http://q.net/", "http://sub.spam-farm.example.org/en/", "http://myspam-farm.example.org/", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == (None, "allow")
    assert got[6][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "allow")
    assert got[8] == ("net", "", None, "allow") and got[9][2:] == ("net/", "block")
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "allow")
    assert got[12][:2] == ("b:", "//c/d")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_edges(spark):
    """Repeated urls, missing and repeated ids, columns whose names are used inside; and a list that can't be sent."""
    rows = [(None, "http://net/x"), (1, "http://net/x"), (1, "http://net/x"), (1, "http://a.org/fr/" + "x" * 100_000)]
    pages = spark.createDataFrame([(i, u, "h", "p", "k") for i, u in rows], "page_id long, url string, host string, path string, keys string")
    got = url_filter.judge_urls(pages).collect()
    assert Counter((r["page_id"], r["rule"]) for r in got) == Counter([(None, "net/"), (1, "net/"), (1, "net/"), (1, "org/fr/")])
    with pytest.raises(ValueError, match="bits"):
        url_filter._level(pages.select(F.col("url").alias("key")), 0, 10**9, 0.5)


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("key like '%7'")
    levels = url_filter.build_cascade(universe, listed)
    assert len(levels) > 1
    wrong = universe.filter(url_filter.is_listed(F.col("key"), levels) != F.col("key").like("%7"))
    assert wrong.count() == 0


# 2 Nearest neighbours ------------------------------------------------------------------------------


def test_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = ann.search(rows).toPandas()
    table = rows.orderBy("vec_id").toPandas()
    x, ids = np.stack(table["embedding"].to_numpy()).astype(float), table["vec_id"].to_numpy()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[np.nonzero(ids == q)[0][0]]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g["vec_id"]))
        total += 20
        assert np.allclose(g.sort_values("rank")["score"], np.sort(s[np.isin(ids, g["vec_id"])])[::-1])
    assert set(got["query_id"]) == {i for i in ids if i % 20 == 0} and hit / total >= 0.9


def test_blocks_and_parts(spark, sf_dir, monkeypatch):
    """Many small blocks, parts of queries and tasks that take several of them: a block widens the radius for itself, so each holds no less than one block of all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = ann.search(rows).toPandas()
    for name, value in (("INDEX_BLOCK", 70), ("QUERY_BLOCK", 4), ("TASKS", 5)):
        monkeypatch.setattr(ann, name, value)
    got = ann.search(rows).toPandas()
    assert len(got) == len(whole) and not got.duplicated(["query_id", "rank"]).any()
    a, b = (t.sort_values(["query_id", "rank"])["score"].to_numpy() for t in (got, whole))
    assert (a >= b - 1e-12).all()


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0]), (20, [-1.0, 0.5]), (None, [1.0, 1.0]), (40, [0.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    near = {q: g.sort_values("rank")["vec_id"].tolist() for q, g in got.groupby("query_id")}
    assert near == {0: [1, 2, 20], 20: [0, 1, 2]}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_vectors_and_queries(spark):
    """Rows that repeat a vec_id count each; columns whose names are used inside."""
    rows = [(0, [1.0, 0.0], 1, "a"), (0, [0.0, 1.0], 2, "b"), (1, [1.0, 0.0], 3, "c"), (1, [1.0, 0.0], 3, "c"), (2, [0.5, 0.5], 4, "d")]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, code string"), k=3).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 1, 1.0), (3, 2, 0.5)] and {r["query_id"] for r in got} == {0}


def test_pigeonhole_finds_all_codes():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    index, bits = ann.BlockIndex(codes), codes.view(np.uint64)
    for r in (0, 3, 8, 21, 28, 50, 64, 128):
        assert index.within(codes[7], r).tolist() == np.nonzero(np.bitwise_count(bits ^ bits[7]).sum(axis=1) <= r)[0].tolist()


def test_probing_looks_values_up():
    """The number of lookups follows from the radius: the values within 2 or 1 bits of eight substrings, at any number of rows."""
    rng = np.random.default_rng(1)
    for rows in (0, 1, 500, 20_000):
        codes = rng.integers(0, 256, (rows, 16), dtype=np.uint8)
        index = ann.BlockIndex(codes)
        index.probed(rng.integers(0, 256, 16, dtype=np.uint8), 2 * ann.PARTS + 3)
        assert index.lookups == 4 * (1 + 16 + 120) + 4 * (1 + 16)


def test_index_touches_and_reranks_a_part(spark, sf_dir):
    """On clustered vectors probing leaves most rows alone; on the driver's, which point everywhere, codes still spare most of the reranking."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 64))
    x = np.repeat(centres, 20, axis=0) + 0.15 * rng.normal(size=(4000, 64))
    coder = ann.learn(x, 19, 0.95)
    codes = coder.codes(x)
    index = ann.BlockIndex(codes)
    assert np.mean([len(index.probed(codes[i], coder.radius)) for i in range(0, 4000, 50)]) < 0.15 * len(x)
    y = np.stack(spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()["embedding"].to_numpy()).astype(float)
    coder = ann.learn(y, 20, 0.95)
    codes = coder.codes(y)
    index = ann.BlockIndex(codes)
    assert np.mean([len(index.within(c, coder.radius)) for c in codes]) < 0.35 * len(y)


# 3 Byte-level BPE ----------------------------------------------------------------------------------


def test_encoding(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    texts, df = edges(spark)
    texts, df = [*texts, "<|endoftext|> don't 12 34!"], df.union(frame(spark, ["<|endoftext|> don't 12 34!"], [99]))
    got = bpe.encode_documents(df, path, public_tokenizers.PATTERN).collect()
    want = Counter((tuple(coder.encode_ordinary(t or "")), (t or "").encode()) for t in texts)
    assert Counter((tuple(np.frombuffer(r["token_ids"], "<u4").tolist()), bytes(r["decoded"])) for r in got) == want
    for most in (1, 7, 100):
        for t in (LONG[:5000], "a  b\n c" * 50, "x" * 500, "word\n" * 300, "漢字。かな、「もじ」" * 60, "don't (\'s) x='s;y=['re]" * 40, "a\u2003\u2003b\x1c \xa0c\r\n\r\n d" * 40, "été,naïve 12,5€!? 's" * 40):
            assert "".join(bpe.safe_pieces(t, most)) == t
            assert most > 1 or t[0] == "x" or len(list(bpe.safe_pieces(t, most))) > len(t) / 20
            assert [i for p in bpe.safe_pieces(t, most) for i in coder.encode_ordinary(p)] == coder.encode_ordinary(t)
    assert bpe.encode_documents(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_long_runs_are_encoded(spark):
    """Runs of three million characters of one kind, alone and between words: decoded byte by byte, and equal to the library where it can do them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    runs = [c * (3_000_000 // len(c)) for c in (" ", "\n", " \n\t\r", "\u3000", "a", "!")]
    texts = [t for r in runs for t in (r, f"word{r}", f"{r}word", f"word{r}'s {r[:70_000]}")]
    got = bpe.encode_documents(frame(spark, texts), path, public_tokenizers.PATTERN).select("doc_id", "n_tokens", F.sha2("decoded", 256).alias("d"), F.length("token_ids").alias("n")).collect()
    assert {r["doc_id"]: r["d"] for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    assert all(r["n"] == 4 * r["n_tokens"] > 0 for r in got)
    for t in (" " * 200_000, "a" + " " * 200_000 + "b", " \n \t " * 50_000 + "x", "x y" + "\n" * 150_000 + " z", "\t" * 70_000 + "!!" + " " * 70_000 + "'s", "a" * 65_536 + " " * 65_536 + "b" + "\u3000" * 70_000):
        ids = [i for p, one in bpe.matched_pieces(t) for i in (coder._encode_single_piece(p) if one else coder.encode_ordinary(p))]
        assert ids == coder.encode_ordinary(t)


# 4 Quality classifier ------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    got = queries.op4_factorisation_machine(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    assert ((got["score"] >= 0) & (got["score"] <= 1) & ((got["score"] >= 0.5) == (got["predicted"] == 1))).all()


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.1, rng.normal(size=30), rng.normal(size=(30, 4)))
    i, x = np.array([1, 4, 9, 20]), np.array([0.5, -1.0, 0.2, 0.7])
    z = 0.1 + machine.linear[i] @ x + sum(machine.factors[i[a]] @ machine.factors[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert abs(machine.score(i, x) - 1 / (1 + np.exp(-z))) < 1e-12


def test_classifier_as_a_whole(spark, sf_dir):
    """Scores of all rows by all pairs of features, with the machine of the same rows fitted here."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in rows}
    seen = {i: quality.features(r["text"], r["n_chars"]) for i, r in rows.items()}
    order = sorted(marks)
    machine = quality.fit([seen[i][0] for i in order], [seen[i][1] for i in order], np.array([marks[i] for i in order], dtype=float))
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, quality.train(docs, labels)).collect()}
    assert set(got) == set(rows)
    for i in list(rows)[:40]:
        cols, x = seen[i]
        gram = machine.factors[cols] @ machine.factors[cols].T * np.outer(x, x)
        z = machine.bias + machine.linear[cols] @ x + (gram.sum() - np.trace(gram)) / 2
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_sample_is_bounded(spark, monkeypatch):
    """Ids that repeat thousands of times give one row each; recorded lengths may be missing or absurd."""
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda index, value, label, **_: sizes.append(len(label)) or quality.Machine(0.0, np.zeros(quality.BUCKETS + 12), np.zeros((quality.BUCKETS + 12, 2))))
    docs = spark.range(6000).select((F.col("id") % 6).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 2 == 0, -5).alias("n_chars"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    machine = quality.train(docs, labels, max_train=4)
    assert 0 < sizes[0] <= 4
    assert quality.classify(docs, machine).filter("score = 0.5").count() == 6000
    assert quality.classify(docs.drop("n_chars"), machine).count() == 6000


def test_classifier_edges(spark):
    _, df = edges(spark)
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (5, None), (1000, 1), (4, 0)], "doc_id long, quality int")
    machine = quality.train(df, labels)
    got = quality.classify(df, machine).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.accepted(df, machine).columns == df.columns
    assert quality.train(df, labels.limit(0)).score(*quality.features("x")) == 0.5


# 5 SimHash -----------------------------------------------------------------------------------------


def brute_print(text, k):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits):
    ids, root = list(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shard, block", [(8192, 16_384), (20, 16)])
def test_simhash_groups(spark, sf_dir, docs, monkeypatch, shard, block):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "BLOCK", block)
    got = {r["doc_id"]: (int(r["f0"]) % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    prints = {i: brute_print(t, 3) for i, t in docs.items()}
    assert {i: g[0] for i, g in got.items()} == prints
    assert {i: g[1] for i, g in got.items()} == brute_groups(prints, 3)


def test_trees_lose_no_link(spark, monkeypatch):
    """Chains of prints, three bits each, over many shards and blocks."""
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "BLOCK", 12)
    rng = np.random.default_rng(5)
    prints = []
    for _ in range(60):
        p = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 12))):
            prints.append(p)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                p ^= 1 << int(b)
    prints = dict(enumerate(sorted(set(prints))))
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints.values()]
    nodes = spark.createDataFrame(signed, "f0 long").withColumn("node", F.col("f0"))
    roots = {r["u"]: r["root"] for r in simhash.components(simhash.link_prints(nodes, 1, 3, simhash.HALVES)).collect()}
    want = brute_groups({i: p for i, p in prints.items()}, 3)
    group = lambda i: roots.get(signed[i][0], signed[i][0])
    assert len({group(i) for i in prints}) == len(set(want.values()))
    assert all(group(i) == group(j) for i, j in want.items())


def test_simhash_edges(spark):
    _, df = edges(spark)
    got = [r.asDict() for r in simhash.near_duplicates(df).collect()]
    assert len(got) == df.count()
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by[0] == by[1] == by[2] == 0 and by[4] == by[5] == 4
    kept = simhash.one_of_each_group(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {0, 3, 4, 7, 8, 9}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_kept(texts, ids):
    """Rows that one_of_each_group keeps, by all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or "")):
        least.setdefault(root[i], i)
    return sorted(least.values())


@pytest.mark.parametrize("last", [400_000, 0])
def test_near_copies_by_all_pairs(spark, sf_dir, docs, monkeypatch, last):
    """Copies on either side of 0.8, of texts with and without repeated lines, and short ones."""
    monkeypatch.setattr(jaccard, "LAST", max(1, last))
    rng = np.random.default_rng(8)
    texts = list(docs.values())
    for n in (6, 12, 60, 61, 200, 480):
        for repeats in (0, 3):
            words = [f"w{x}" for x in rng.integers(0, 10**6, n)] + [f"line{x}" for x in range(12)] * (repeats * n // 12)
            texts.append(" ".join(words))
            for share in (0.005, 0.01, 0.02, 0.022, 0.025, 0.03, 0.04, 0.1):
                other = list(words)
                for at in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
                    other[at] = f"x{rng.integers(0, 10**6)}"
                texts += [" ".join(other), " ".join(words[: int(len(words) * (1 - 4 * share))])]
    got = sorted(r["doc_id"] for r in simhash.one_of_each_group(frame(spark, texts)).collect())
    assert got == brute_kept(texts, list(range(len(texts))))


def test_near_copies_row_by_row(spark):
    """Rows without an id, rows that share one, and equal rows."""
    near, clean = BASE.replace("alpha89", "other"), [" ".join(f"{w}{i}" for i in range(40)) for w in ("b", "c", "d")]
    rows = [(1, BASE), (1, BASE), (1, clean[0]), (2, near), (2, clean[1]), (None, near), (None, clean[2]), (None, clean[2]), (None, None), (None, "")]
    texts, ids = [t for _, t in rows], [i for i, _ in rows]
    got = simhash.one_of_each_group(frame(spark, texts, ids))
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == Counter((ids[i], texts[i] or "") for i in brute_kept(texts, ids))


# 6 and 10 Repeated passages ------------------------------------------------------------------------


def brute_bytes(texts, window=200):
    """Result by the order of the texts."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - window + 1):
            if count[r[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append((len(r), int(gone.sum()), np.frombuffer(r, np.uint8)[~gone].tobytes()))
    return out


def brute_words(texts, window=20):
    seen, out = set(), []
    for t in texts:
        words = WORD.findall(t or "")
        gone = np.zeros(len(words), dtype=bool)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = True
            seen.add(key)
        out.append((len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def mixed_texts():
    rng = np.random.default_rng(11)
    phrases = [" ".join(f"p{k}q{rng.integers(50)}" for _ in range(int(rng.integers(15, 60)))) for k in range(6)]
    texts = []
    for i in range(60):
        parts = [phrases[int(rng.integers(6))] if rng.random() < 0.4 else " ".join(f"u{rng.integers(10**6)}" for _ in range(int(rng.integers(5, 40)))) for _ in range(6)]
        texts.append("\n".join(parts))
    return [*texts, *texts[:8], "z " * 200, "", None, "ab" * 400, "ab" * 400, LONG, LONG[200:]]


@pytest.mark.parametrize("most, rows, batches", [(32_768, 16_384, 4), (2, 5, 4), (40, 16_384, 3), (32_768, 50, 1)])
def test_bytes_that_repeat(spark, monkeypatch, most, rows, batches):
    monkeypatch.setattr(suffix, "CROWD", most)
    monkeypatch.setattr(suffix, "_ROWS", rows)
    texts = mixed_texts()
    got = {r["doc_id"]: r for r in suffix.remove_repeats(frame(spark, texts), batches=batches).collect()}
    for i, (n, gone, kept) in enumerate(brute_bytes(texts)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == (n, gone, kept), i
        assert sum(s["end"] - s["start"] for s in got[i]["removed"]) == gone


def test_only_merges_write_levels(spark, monkeypatch):
    """Seven batches: each is written once and then by the merges it takes part in; scans of larger levels write findings only."""
    made = []

    class Noted(suffix.IndexFamily):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(suffix, "IndexFamily", Noted)
    texts = mixed_texts()
    got = {r["doc_id"]: r for r in suffix.remove_repeats(frame(spark, texts), batches=7).collect()}
    for i, (n, gone, kept) in enumerate(brute_bytes(texts)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == (n, gone, kept), i
    assert [level.size for level in made[0].levels] == [4, 2, 1]
    assert sorted(made[0].written) == [1] * 7 + [2] * 3 + [4]
    assert len(made[0].findings) == 5 and sum(f.count() for f in made[0].findings) > 0


@pytest.mark.parametrize("most", [2000, 1])
def test_words_that_repeat(spark, monkeypatch, most):
    monkeypatch.setattr(substring, "SHARD_RUNS", most)
    texts = mixed_texts()
    got = {r["doc_id"]: r for r in substring.remove_repeats(frame(spark, texts)).collect()}
    for i, want in enumerate(brute_words(texts)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == want, i


def named_rows():
    """Rows that repeat an id with equal and with other texts, and rows without one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    return [(1, b), (5, a), (5, b), (5, b), (None, c), (None, c + " end"), (None, a[:150]), (7, c), (7, "x"), (None, None), (8, "d " + b), (5, None)]


def test_repeated_and_missing_ids(spark):
    rows = named_rows()
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    want = Counter((i, *w) for (i, _), w in zip(rows, brute_bytes([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix.remove_repeats(df).collect()) == want
    # Words: different rows in the order of id (null first) and the hash of the text; equal rows are one document.
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    told = dict(zip(order, brute_words([t for _, t in order]), strict=True))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(df).collect())
    assert got == Counter((i, *told[i, t]) for i, t in rows)


def test_passages_of_the_driver_table(spark, sf_dir, docs):
    ids = sorted(docs)
    words = {r["doc_id"]: r for r in queries.op10_suffix_automata(spark, sf_dir).collect()}
    for i, (n, gone, kept) in zip(ids, brute_words([docs[i] for i in ids]), strict=True):
        assert (words[i]["n_words"], words[i]["n_removed"], words[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    found = {r["doc_id"]: r for r in queries.op6_suffix_family(spark, sf_dir).collect()}
    for i, (n, gone, kept) in zip(ids, brute_bytes([docs[i] for i in ids]), strict=True):
        assert (found[i]["n_bytes"], found[i]["n_removed"], found[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept).hexdigest())


def test_passage_edges(spark):
    texts, df = edges(spark)
    for f in (suffix.remove_repeats, substring.remove_repeats):
        assert f(df).count() == len(texts)
        assert f(df.limit(0)).count() == 0
    kept = substring.without_repeats(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    rows = {r["doc_id"]: r for r in kept.collect() if r["doc_id"] is not None}
    assert rows[4]["text"] == "" and rows[4]["n_chars"] == 0  # the row without id has it first
    assert rows[7]["text"] == LONG and rows[7]["key"] == 1


def test_automaton_matches():
    rng = np.random.default_rng(2)
    held = [rng.integers(0, 3, 40).tolist() for _ in range(5)]
    automaton = substring.SuffixAutomaton()
    for h in held:
        automaton.add(h)
    asked = rng.integers(0, 3, 60).tolist()
    known = {tuple(h[i:j]) for h in held for i in range(40) for j in range(i + 1, 41)}
    want = [max([n for n in range(1, e + 2) if tuple(asked[e + 1 - n : e + 1]) in known], default=0) for e in range(60)]
    assert automaton.matches(asked) == want


def test_runs_cover_each_window_once():
    raws = [t.encode() for t in ("a b c " * 30, "", BASE, LONG, "x")]
    cut = passages.word_units(raws)
    assert np.diff(cut.start).tolist() == [len(r.split()) for r in raws]
    found = passages.runs(cut, 20, 6)
    at = np.sort(passages.windows_of(found, cut.start))
    assert at.tolist() == [s for a, b in zip(cut.start, cut.start[1:], strict=False) for s in range(a, b - 19)]


# 7 Quality rules -----------------------------------------------------------------------------------


def test_rule_edges(spark):
    texts, df = edges(spark)
    got = rules.apply_rules(df).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["n_words"] == by[1]["n_words"] == by[2]["n_words"] == 0 and by[0]["base_failed"]
    assert by[4]["n_repeat_words"] == 0 and not by[4]["base_failed"]
    assert by[8]["word_chars"] == 5000
    assert rules.apply_rules(df.limit(0)).count() == 0


# 8 Mixing ------------------------------------------------------------------------------------------


def test_targets():
    got = mixing.source_targets({"b": 100, "a": 100, None: 100, "c": 1000}, (3, 1, 2), 1.5, 2)
    assert got["a"] == 200 and got["c"] <= 2000 and abs(sum(got.values()) - 1950) < 1e-6
    assert mixing.source_targets({"a": 0}, (3, 1, 2), 1.5, 2) == {"a": 0.0}


def test_knapsack_is_exact_where_it_can_be():
    rng = np.random.default_rng(3)
    for _ in range(30):
        size = np.unique(rng.integers(1, 60, 8))
        count = rng.integers(1, 5, len(size))
        if rng.random() < 0.5:
            count[:] = 1
        for budget in rng.integers(0, int((size * count).sum()), 5):
            take = mixing.fit_counts(size, count, int(budget))
            words = int((take * size).sum())
            assert (take >= 0).all() and (take <= count).all()
            reach = {0}
            for s, c in zip(size, count, strict=True):
                reach = {r + s * k for r in reach for k in range(c + 1)}
            assert words in reach and abs(budget - words) <= size.max()
            if (count == 1).all():
                assert abs(budget - words) == min(abs(budget - r) for r in reach)


def test_mix(spark):
    texts, df = edges(spark)
    got = mixing.mix(df).toPandas()
    again = mixing.mix(df.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert Counter(map(str, got[key].itertuples(index=False))) == Counter(map(str, again[key].itertuples(index=False)))
    assert (got["taken"] <= 2 * got["size"]).all()
    assert sorted(got["size"]) == sorted(len(WORD.findall(t or "")) for t in texts)
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_of_the_driver_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max() / 2 + 1


def test_mix_as_a_whole(spark, sf_dir):
    """Targets, counts by length and the seeded choice, written out over all rows; rows without id are dealt to many parts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    draw = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")), F.lit(42))
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or "")), r["draw"]) for r in docs.select("doc_id", "source", "text", draw.alias("draw")).collect()]
    assert len({r[3] % mixing.PARTS for r in rows if r[0] is None}) > 30
    totals = Counter()
    for _, source, size, _ in rows:
        totals[source] += size
    want = Counter()
    for source, target in mixing.source_targets(dict(totals), (3, 1, 2), 1.5, 2).items():
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[2], r[3] % mixing.PARTS, r[3]))
        sizes = np.array(sorted({r[2] for r in mine if r[2]}))
        counts = np.array([sum(r[2] == n for r in mine) for n in sizes])
        base = round(target) // totals[source]
        extra = dict(zip(sizes.tolist(), mixing.fit_counts(sizes, counts, round(target) - base * totals[source]).tolist(), strict=True))
        nth = Counter()
        for i, _, size, _ in mine:
            nth[size] += 1
            want[i, size, (base + (nth[size] <= extra[size])) * size if size else 0] += 1
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == want


def test_mix_takes_each_row_by_itself(spark):
    """Rows without an id or that repeat one, of other texts and sources, and equal rows."""
    rng = np.random.default_rng(4)
    texts = [None, "", *[f"t{i} " * int(n) for i, n in enumerate(rng.integers(1, 40, 60))], *["same text here"] * 7]
    df = frame(spark, texts, [None if i % 3 == 0 else i % 4 for i in range(len(texts))])
    want = mixing.mix(df).toPandas()
    got = mixing.mixed_documents(df).toPandas()
    size = got["text"].map(lambda t: len(WORD.findall(t or "")))
    assert (size > 0).all() and size.sum() == want["taken"].sum()
    assert Counter(size) == Counter({n: c for n, c in want.groupby("size")["copies"].sum().items() if c})


# 9 License rules -----------------------------------------------------------------------------------


def test_licenses(spark):
    texts = [None, "", "Hello. RELEASED   under the *MIT* License!", "x\nLicensed under CC BY-NC 4.0.\nthis work is licensed under the GNU General Public License, version 3.", "Released under the MIT License, maybe", "You may not use this file except in compliance with the License.", *[". ".join(license.SENTENCES.get(k, k) for k in ks) for ks in (("licensed under the Apache License, Version 2.0", "apache_use", "apache_copy"), ("apache_use", "apache_copy", "mit_notice"))]]
    got = {r["doc_id"]: (r["licenses"], r["kind"]) for r in license.scan_licenses(frame(spark, texts)).collect()}
    assert got[0] == got[1] == ([], "none")
    assert got[2] == (["MIT"], "permissive") and got[3] == (["CC-BY-NC-4.0", "GPL-3.0"], "non-commercial")
    assert got[4] == got[5] == ([], "none")
    assert got[6] == (["Apache-2.0"], "permissive") and got[7] == ([], "none")


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
LGPL = GPL.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
AGPL = GPL.replace("GNU General", "GNU Affero General")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


BSD3_OWNED = BSD3.replace("the copyright holder nor", "Example, Inc. nor")


def test_names_in_sentences(spark, tmp_path):
    """Clauses at the end of a sentence, and the edges of the table; SQL gives the same."""
    cases = {
        "This project is released under the MIT License.": ["MIT"],
        "The data set is available under CC BY-SA 4.0. Enjoy": ["CC-BY-SA-4.0"],
        "// SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"],
        "Code is licensed under the terms of the GNU Lesser General\nPublic License, version 2.1; docs are licensed under CC-BY-NC 4.0": ["CC-BY-NC-4.0", "LGPL-2.1"],
        "It is not released under the MIT License.": [],
        "Released under the MIT License by others.": [],
        "x " * 30_000 + ". Released under the ISC license": ["ISC"],
        "Distributed under the BSD 3-Clause License. Licensed under the MIT license! Released under the MIT license": ["BSD-3-Clause", "MIT"],
        "SPDX-License-Identifier: GPL-2.0": ["GPL-2.0"],
        "/* SPDX-License-Identifier: GPL-2.0+ WITH Linux-syscall-note */": ["GPL-2.0"],
        "# SPDX-License-Identifier: MIT OR Apache-2.0\nimport os": ["Apache-2.0", "MIT"],
        "// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 OR BSL-1.0) AND MIT": ["BSL-1.0", "GPL-2.0", "MIT"],
        "SPDX-License-Identifier: MIT-0-like": [],
        "This is licensed under MIT license (see LICENSE.txt)": ["MIT"],
        "Dual licensed under either the MIT License or the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
        "The MIT License (MIT)\n\nCopyright (c) 2020 A. Person": ["MIT"],
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n": ["GPL-3.0"],
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": ["GPL-2.0"],
        "It is no longer licensed under the MIT License.": [],
        "The code was never released under the GNU GPL v3. It isn't licensed under the ISC license": [],
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)": ["BSL-1.0"],
        "Licensed under the EUPL, Version 1.2 or later": ["EUPL-1.2"],
        "Released under the GNU General Public License, version 3 or later.": ["GPL-3.0"],
        "Licensed under the EUPL-1.2-or-later": ["EUPL-1.2"],
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": ["EPL-2.0"],
        "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.": ["GPL-2.0"],
        "            The Artistic License 2.0\n\n     Copyright (c) 2000-2006": ["Artistic-2.0"],
    }
    texts = [*cases, *cases, None, "", MIT, GPL, BSD3, MPL, ZLIB, BSD3_OWNED]
    df = frame(spark, texts, [None if i % 4 == 0 else i // 2 for i in range(len(texts))])
    got = license.scan_licenses(df)
    told = Counter((r["doc_id"], tuple(r["licenses"])) for r in got.collect())
    want = [*cases.values(), *cases.values(), [], [], ["MIT"], ["GPL-3.0"], ["BSD-3-Clause"], ["MPL-2.0"], ["Zlib"], ["BSD-3-Clause"]]
    assert told == Counter((None if i % 4 == 0 else i // 2, tuple(w)) for i, w in enumerate(want))
    assert license.scan_licenses(df.limit(0)).count() == 0
    df.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/d")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    rows = con.execute(license.oracle_sql()).fetchall()
    mine = got.select("doc_id", "n_sentences", F.array_join("sentence_ids", "|"), F.array_join("licenses", ","), "kind").collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mine))


@pytest.mark.parametrize("lead", ["", "    ", " * ", "# "])
def test_genuine_notices(spark, lead):
    names = {"MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0": GPL, "GPL-2.0": GPL.replace("version 3", "version 2"), "LGPL-2.1": LGPL, "AGPL-3.0": AGPL, "MPL-2.0": MPL, "ISC": ISC, "CC0-1.0": CC0, "Zlib": ZLIB, "Unlicense": "This is free and unencumbered software released into the public domain."}
    texts = ["Copyright (c) 2020 A. Person\n\n" + "\n".join(lead + x for x in t.split("\n")) for t in names.values()]
    texts += [t.replace("\n", "\r\n") for t in texts] + ["Released under\n\nthe MIT License.", "Not released under\nthe MIT License.", "Released under the. MIT License."]
    got = [r["licenses"] for r in license.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[n] for n in names] * 2 + [[], [], []]


# The pipeline --------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, docs):
    """Every stage on what the one before kept, each against its brute-force version."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "near-duplicates", "repeated passages", "source mix", "byte-level BPE"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages["quality classifier"](spark, start, sf_dir)
    rows = {r["doc_id"]: r for r in kept.collect()}
    machine = quality.train(start, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    lengths = {r["doc_id"]: r["n_chars"] for r in start.select("doc_id", "n_chars").collect()}
    assert set(rows) == {i for i, t in docs.items() if machine.score(*quality.features(t, lengths[i])) >= 0.5} and kept.columns == start.columns
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in rows for i in good) >= 0.97 * len(good)
    apart = stages["near-duplicates"](spark, kept, sf_dir)
    ids = sorted(rows)
    left = [ids[i] for i in brute_kept([rows[i]["text"] for i in ids], ids)]
    assert sorted(r["doc_id"] for r in apart.collect()) == left and apart.columns == start.columns
    cut = stages["repeated passages"](spark, apart, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    for i, (_, gone, want) in zip(left, brute_words([rows[i]["text"] for i in left]), strict=True):
        assert " ".join(WORD.findall(texts[i] or "")) == want and (gone or texts[i] == rows[i]["text"])
    taken = Counter(r["doc_id"] for r in stages["source mix"](spark, cut, sf_dir).collect())
    plan = mixing.mix(cut).toPandas()
    assert taken == Counter({i: n for i, n in zip(plan["doc_id"], plan["copies"], strict=True) if n})
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in out) == taken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    for r in out:
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == coder.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows and ids, a long text, further columns; then empty tables."""
    import corpus_pipeline

    _, df = edges(spark)
    df = df.unionByName(df.filter("doc_id in (7, 9)")).select("doc_id", "text", "lang", "source", "n_chars", "key", "run")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r["doc_id"] for r in got} <= {3, 4, 7, 8, 9, None} and any(r["doc_id"] == 7 for r in got)
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
