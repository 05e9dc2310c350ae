"""Operator 12 against plain comparison of all stretches."""

import hashlib
import random
import re
import zlib

from lodestone.llm import periodic_runs as P


def brute(s, words, exponent):
    n, out = len(s), set()
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(words, exponent * p) and not any(all(s[k] == s[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                out.add((i, length, p))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_same_runs_as_all_stretches():
    rnd = random.Random(5)
    for _ in range(1500):
        s = [rnd.randrange(rnd.choice([1, 2, 2, 3])) for _ in range(rnd.randrange(0, 36))]
        if rnd.random() < 0.5 and s:
            s = s[: rnd.randrange(len(s))] + s[: rnd.randrange(1, 5)] * rnd.randrange(2, 8) + s[:3]
        for words, exponent in ((6, 4), (2, 2), (3, 3)):
            assert P.runs(s, words, exponent) == brute(s, words, exponent)


def test_compared_letters_are_linear():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [[0] * 20_000, fibonacci[-1], ([0] * 30 + [1]) * 600, [bin(i).count("1") & 1 for i in range(20_000)], [0] * 999 + ([1] + [0] * 998) * 20, [random.Random(1).randrange(2) for _ in range(20_000)]]
    for s in texts:
        for order in (s, [1 - x for x in s]):
            looked = []
            P.roots(order, 2, looked)
            assert looked[0] <= 2 * len(s)


def want(doc, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w, 6, 4)
    gone = {i for a, m, p in found for i in range(a + p, a + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{m},{p}\n" for a, m, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_rows_nulls_ties_and_clashing_columns(spark):
    rnd = random.Random(9)
    rows = [(None, "a a a a a a a"), (0, None), (1, ""), (2, " \t "), (3, "x y\x85z"), (3, "x y\x85z")]
    for d in range(10, 150):
        w = [rnd.choice(["a", "b", "É", "cc"]) for _ in range(rnd.randrange(0, 60))]
        if rnd.random() < 0.4:
            w[5:5] = w[:3] * rnd.randrange(2, 9)
        rows.append((d, rnd.choice([" ", "\n", "  "]).join(w)))
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, data string, start int").repartition(3)
    key = lambda r: (str(r[0]), r[6])
    got = sorted((tuple(r)[:8] for r in P.digests(frame).collect()), key=key)
    assert got == sorted(((d, *want(d, t)) for d, t in rows), key=key)
    found = P.find(frame.where("doc_id is null")).collect()
    assert [tuple(r) for r in found] == [(None, 0, 7, 1, "a")]
    assert P.digests(frame.limit(0)).count() == 0


def test_long_text_is_split_as_a_short_one(monkeypatch):
    text = (" wörd x\n" * 500).encode()
    monkeypatch.setattr(P, "PIECE", 100)
    monkeypatch.setattr(P, "JOINED", 7)
    assert P.words_of(text) == text.split()
    assert P.joined_sha256(text.split(), bytearray([1] * 20 + [0, 1] * 490)) == hashlib.sha256(b" ".join(text.split()[20::2])).hexdigest()
