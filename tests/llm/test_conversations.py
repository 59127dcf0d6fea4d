"""Repair, prefix trie and language identification against brute-force versions, and their edges."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import language, prefixes, repair

CONV = "conv_id long, turn long, role string, text string, key string, node int, pos int"
DOCS = "doc_id long, text string, lang string, source string, known int, place double"


def conversations(spark, rows):
    """Rows of (conv_id, turn, role, text), with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONV)


# 11 Structure repair -------------------------------------------------------------------------------


def brute_repair(rows):
    """All edits with up to three inserts at each place, tried one by one. rows: (turn, role, text) in order."""
    codes, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        codes.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        if any(c in ("blank", "duplicate") and x != "D" for c, x in zip(codes, letters, strict=True)):
            continue
        for gaps in itertools.product(range(4), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(x + "I" * g for x, g in zip(letters, gaps[1:], strict=True))
            size, at, out, fits = len(audit) - audit.count("D"), 0, [], True
            goal = ("s" if size % 2 else "") + "ua" * (size // 2)
            for x in audit:
                role, text = (None, "") if x == "I" else rows[at][1:]
                at += x != "I"
                if x == "D":
                    continue
                want = goal[len(out)]
                fits = fits and (role[:1] == want if x == "K" else want != "s")
                out.append((role if x == "K" else {"u": "user", "a": "assistant"}.get(want, "?")) + ":" + text)
            if not fits or size == 1:
                continue
            cost = 3 * audit.count("I") + 3 * audit.count("R") + 4 * audit.count("D") + sum(3 for c, x in zip(codes, letters, strict=True) if c == "truncated" and x != "D")
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[codes.count(c) for c in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), *best)


def told(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def random_rows(n, longest, seed=3):
    rng = np.random.default_rng(seed)
    roles, texts = ["system", "user", "assistant", "tool", ""], ["yes.", "no", " \n", "why?", "so on"]
    return {c: [(int(t), roles[rng.integers(5)], texts[rng.integers(5)]) for t in sorted(rng.choice(9, rng.integers(0, longest + 1), replace=False))] for c in range(n)}


@pytest.mark.parametrize("bits, node", [(10, 6), (1, 1)])
def test_repair_tries_all_edits(spark, monkeypatch, bits, node):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    monkeypatch.setattr(repair, "NODE_BITS", node)
    rows = {c: r for c, r in random_rows(60, 4).items() if r}
    got = told(repair.reports(repair.undamaged(conversations(spark, [(c, *x) for c, r in rows.items() for x in r]))))
    assert got == {c: brute_repair(r) for c, r in rows.items()}


def test_long_conversation_is_repaired_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(7, t, ["user", "assistant", "tool"][rng.integers(3)], f"{t % 50}" + (".!?x"[rng.integers(4)])) for t in range(3000)]
    rows += [(c, 0, "user", "a.") for c in range(100, 140)]
    whole = told(repair.reports(repair.undamaged(conversations(spark, rows))))
    monkeypatch.setattr(repair, "SEGMENT_BITS", 4)
    monkeypatch.setattr(repair, "NODE_BITS", 2)
    done = repair.Repair(repair.undamaged(conversations(spark, rows)).repartition(7))
    assert done.leaves.filter("key = '7'").count() > 100
    turns = done.turns().filter("conv_id = 7").orderBy("segment", "place").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == whole[7][7]
    assert told(repair.reports(repair.undamaged(conversations(spark, rows)))) == whole
    assert whole[7][5] > 0 and whole[100][6] == "KI"
    done.discard()


def test_repair_edges(spark):
    """Nulls, repeated rows, a conversation that loses all rows, very long texts, no rows at all."""
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    plain = [next(c for c in range(2000 + 100 * i, 2100 + 100 * i) if zlib.crc32(f"{c}:0".encode()) % 20 > 4) for i in range(2)]
    rows = [(dropped, 0, "user", "x."), (None, None, None, None), (None, None, None, None), (None, 1, "user", None), (plain[0], 0, "system", "word " * 200_000 + "."), (plain[0], 0, "system", "word " * 200_000 + "."), (plain[1], 0, "user", "\n" * 100_000 + "x")]
    got = told(repair.reports(repair.damaged(conversations(spark, rows))))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert set(got) == {dropped, None, *plain} and got[None][0] == 0 and set(got[None][6]) <= {"D"}
    assert got[plain[0]][2] == 1 and got[plain[0]][6] in ("DD", "KDII") and got[plain[1]][5:7] == (4, "D")
    assert repair.reports(repair.damaged(conversations(spark, rows).limit(0))).count() == 0


def test_matrices_are_associative():
    rng = np.random.default_rng(2)
    codes = "".join(chr(65 + rng.integers(16)) for _ in range(24))
    whole = repair.segment_matrix(codes)
    for cut in (1, 8, 13):
        assert repair.times(repair.segment_matrix(codes[:cut]), repair.segment_matrix(codes[cut:])) == whole


# 12 Prefix trie ------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = {}
    mark = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, mark(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = {}
    for node, members in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(node))
        row = (
            min(nodes[node[:-1]]) if node else None,
            len(members),
            sum(len(x) == len(node) + 1 for x in below),
            len(childless),
            sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
        out.setdefault((min(members), len(node)), []).append(row)
    return {k: sorted(v, key=str) for k, v in out.items()}


def trie(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["conv_id"], r["depth"]), []).append((r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]))
    return {k: sorted(v, key=str) for k, v in out.items()}


@pytest.mark.parametrize("bits", [10, 1])
def test_trie_of_small_conversations(spark, monkeypatch, bits):
    """Few different turns, so that many prefixes are shared; nulls, ties, repeated rows, null ids, blocks of two turns."""
    monkeypatch.setattr(prefixes, "BLOCK_BITS", bits)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(40):
        for t in range(int(rng.integers(1, 14))):
            x = int(rng.integers(0, 20))
            rows.append((c, None if x == 0 else t - (x == 1), None if x == 2 else "user" if t % 2 else "assistant", None if x == 3 else "é" if x < 12 else f"t{x}"))
    rows += [rows[0], rows[0], (None, 1, "user", "x"), (None, None, None, None), (998, 0, "user", "x" * 300_000), (999, 0, "a", ""), (10**12 + 4, 0, "user", "é")]
    assert trie(prefixes.prefix_trie(conversations(spark, rows))) == brute_trie(rows)


def test_deep_trie(spark, monkeypatch):
    """Copies of one long conversation: all ancestors are reached in as many rounds as the depth has bits."""
    monkeypatch.setattr(prefixes, "BLOCK_BITS", 4)
    rows = [(c, t, "user", f"{t}") for c in (0, 5, 10) for t in range(150)] + [(15, t, "user", f"{t}") for t in range(70)]
    assert trie(prefixes.prefix_trie(conversations(spark, rows))) == brute_trie(rows)


def test_trie_edges(spark):
    assert prefixes.prefix_trie(conversations(spark, [(0, 0, "u", "x")]).limit(0)).count() == 0
    turnless = next(c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    got = trie(prefixes.prefix_trie(conversations(spark, [(turnless, 0, "user", "x")])))
    assert got == {(turnless, 0): [(None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]}


# 13 Language identification ------------------------------------------------------------------------


def documents(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 0.5) for r in rows], DOCS)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    row = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("least"), F.max("score").alias("most")).first()
    assert row["a"] > 0.97 and 0 <= row["least"] <= row["most"] <= 1


def test_families_come_first():
    """Classes of one family are told apart by its own machines only, and unlisted languages are families."""
    rng = np.random.default_rng(0)
    centres = {"en": 0, "de": 1, "fr": 2, "tlh": 3}
    x = np.zeros((400, 5), dtype=np.float32)
    langs = np.array(list(centres) * 100)
    for i, v in enumerate(langs):
        x[i, centres[v]] = 1
        x[i] += 0.1 * rng.normal(size=5)
    kin = np.array([language.family(v) for v in langs])
    top = language.fit_pairs(x, kin)
    assert top.classes == ("germanic", "romance", "tlh") and len(top.weights) == 3
    best, sure = top.decide(x)
    assert (np.array(top.classes)[best] == kin).all() and (sure > 0.5).all()
    inner = language.fit_pairs(x[kin == "germanic"], langs[kin == "germanic"])
    assert inner.classes == ("de", "en") and inner.weights.shape == (1, 5)


def test_machine_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = x[:, 0] + 0.5 * rng.normal(size=80) > 0
    loss = lambda w: 0.5 * (w**2).sum() + 10.0 * (np.maximum(0, 1 - np.where(y, 1, -1) * (x @ w)) ** 2).sum()
    w = language.fit_machine(x, y, rounds=500)
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in 0.05 * np.vstack([np.eye(3), -np.eye(3)]))


def test_trigrams_go_over_the_whole_text(monkeypatch):
    text = "Die Kälte! 12 ÄRGER " * 5000
    whole = language.trigrams(text)
    monkeypatch.setattr(language, "_PART", 1000)
    assert (language.trigrams(text) == whole).all() and whole.sum() > 50_000
    assert (language.trigrams("die kälte?") == language.trigrams("DIE KÄLTE!")).all()
    assert language.trigrams(None).sum() == language.trigrams("ab").sum() == 0


def test_language_edges(spark):
    """Null, empty, letterless and long texts, repeated and null ids, one language, nothing to learn, no rows, most of a sample one text."""
    texts = [None, "", "12 !? \n", "a", "the house and the dog " * 50_000, "der Hund und das Haus " * 20]
    rows = [(i, texts[i % 6] if i < 12 else ("the cat and a dog" if i % 2 else "die Katze und ein Hund") + f" {i}", "en" if (i % 6 == 4 if i < 12 else i % 2) else "de") for i in range(60)]
    rows += [(None, "the end of the house", "en"), (3, "x", None), (3, "x", None)] + [(1, "the same text", "en")] * 200
    docs = documents(spark, rows)
    out = language.identify(docs, language.train(docs, max_train=30)).collect()
    assert len(out) == len(rows) and all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in out)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in out)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] is not None and r["doc_id"] > 3}
    assert by_id[6]["lang_pred"] == by_id[7]["lang_pred"] == by_id[8]["lang_pred"] == "und"
    assert by_id[4]["lang_pred"] == "en" and by_id[5]["lang_pred"] == "de"
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    one = language.identify(docs, language.train(docs.filter("lang = 'de'"))).filter("doc_id = 4").first()
    assert (one["lang_pred"], one["score"]) == ("de", 1.0)
    none = language.identify(docs, language.train(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), language.train(docs)).count() == 0
