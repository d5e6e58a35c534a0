import collections
import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from folioscope.llm import merkle
from tests.llm.conftest import ODD

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_tree(text):
    """(root, sections, paragraphs, leaves of each paragraph with the leaf before each)."""
    paragraphs, sections, run, leaves, before = re.findall(r"[^\n]*\n{1,8}|[^\n]+", text), [], [], [], None
    assert "".join(paragraphs) == text
    for k, p in enumerate(paragraphs):
        run.append(sha(p))
        if run[-1][0] in "0123" or k == len(paragraphs) - 1:
            sections.append(sha("".join(run)))
            run = []
        own = re.findall(r"[^.!?\n]{0,15}(?:[.!?]{1,8} {0,8}|\n{1,8})|[^.!?\n]{1,16}", p)
        assert "".join(own) == p
        leaves.append(list(zip(own, [before, *own[:-1]])))
        before = own[-1]
    return sha("".join(sections)), sections, paragraphs, leaves


def fingerprint(text):
    root, sections, _, _ = plain_tree(text)
    return root + ":" + ",".join(s[:16] for s in sections)


def likeness(a, b):
    if a == b:
        return 1.0
    (_, _, p, x), (_, _, q, y) = plain_tree(a), plain_tree(b)
    front = next((k for k, (s, t) in enumerate(zip(p, q)) if s != t), min(len(p), len(q)))
    back = next((k for k, (s, t) in enumerate(zip(p[front:][::-1], q[front:][::-1])) if s != t), min(len(p), len(q)) - front)
    x, y = (collections.Counter(k for own in z[front : len(z) - back] for k in own) for z in (x, y))
    equal = sum(len(s) for s in p[:front]) + sum(len(s) for s in p[len(p) - back :]) + sum(n * len(k[0]) for k, n in (x & y).items())
    return 2 * equal / (len(a) + len(b))


def check(documents, rows):
    found = merkle.edited_fingerprints(documents(rows, fingerprint="mine", n_chars2="stays")).collect()
    assert len(found) == len(rows)
    signed = lambda t: xxhash.xxh64((t or "").encode(), seed=42).intdigest() ^ 1 << 63
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    wanted = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        a, b = fingerprint(text), fingerprint(edited)
        wanted.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(likeness(text, edited), 9), round(likeness(text, after), 9)))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found]
    assert sorted(got) == sorted(wanted)
    assert all(r["n_chars2"] == "stays" for r in found)


def test_like_python(documents):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeé漢") for _ in range(draw.randint(1, 9)))
    rows = [(k * 7 % 101, "".join(word() + draw.choice([" ", " ", " ", ". ", "!\n", "\n\n"]) for _ in range(draw.randint(0, 200)))) for k in range(90)]
    check(documents, rows)


def test_odd_rows(documents):
    check(documents, ODD)
    check(documents, [(5, "the only row. it follows itself.")])
    assert merkle.edited_fingerprints(documents([])).collect() == []


def near(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    return [tuple(r) for r in df.select(merkle.likeness(F.col("a"), F.col("b")), merkle.differing(F.col("a"), F.col("b"))).collect()]


def test_likeness_reads_the_branches(spark):
    draw = random.Random(5)
    text = " ".join(draw.choice(["word", "other", "third", "longer words"]) for _ in range(60))[:330]
    pairs = [("a. b. ", "b. a. "), ("a. ", "a. a. "), ("a.\nb.\n", "b.\na.\n"), (text[:319], text[:321]), (text[:321], text[:323]), ("", "x"), ("", ""), ("\n" * 20, "\n" * 21)]
    found = near(spark, pairs)
    assert [round(f[0], 9) for f in found] == [round(likeness(a, b), 9) for a, b in pairs]
    assert all(f[0] < 1 for f, (a, b) in zip(found, pairs) if a != b)
    assert found[3][0] > 0.9 and found[4][0] > 0.9


def test_differing_branches(spark):
    lines = [f"line {k} of the text, with some words.\n" for k in range(40)]
    other = list(lines)
    other[17:19] = ["line 17 is another one now.\n"]
    (_, at), (_, none) = near(spark, [("".join(lines), "".join(other)), ("a\n", "a\n")])
    ends = [k for k, x in enumerate(lines, 1) if sha(x)[0] in "0123"]
    assert tuple(at) == (1 + sum(e <= 17 for e in ends), 18, 2) and tuple(none) == (0, 0, 0)


def test_many_rows_of_one_id(spark, documents, monkeypatch):
    """They are cut by hash into several ranges; the chain of successors holds every row once."""
    rows = [(7, f"text {k}.") for k in range(900)] + [(None, f"none {k}.") for k in range(300)] + [(k, f"own {k}.") for k in range(8, 100)]
    check(documents, rows)
    plan = merkle.with_next(documents(rows).select("doc_id", "text"), "doc_id", "text", {}, {"text": "after"})
    assert sorted(r["after"] for r in plan.collect()) == sorted(t for _, t in rows)


def test_no_python_in_the_plan(documents):
    plan = merkle.edited_fingerprints(documents([(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "mapPartitions"))
