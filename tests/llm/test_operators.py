"""Operators 1, 3, 4, 6, 9 and 10: brute force, round trips, the contract's cases, odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import decontaminate, flac, licences, private_data, quality, queries
from lodestone.llm import sentencepiece_codec as spm
from lodestone.llm.words import Words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "a " * 3000 + "é\n\n\tb", "en", "s", 1), (3, "a " * 3000 + "é\n\n\tb", "en", "s", 1), (None, "x@y.zz 1.2.3.4", "en", "s", 1)]


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in ("documents", "benchmark"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_odd_rows_and_empty_tables(spark):
    docs, empty = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], DOCS)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = queries.model_path()
    for f, n in (
        (licences.scan, 0), (lambda x: spm.digests(x, model), 5), (flac.digests, 5), (private_data.scan, 5), (lambda x: decontaminate.leaks(x, bench), 0),
        (lambda x: quality.classify(x, labels), 5), (lambda x: decontaminate.leaks(x, bench.limit(0)), 0), (lambda x: quality.classify(x, labels.limit(0)), 5),
    ):
        assert f(docs).count() == n and f(empty).count() == 0


def test_words_are_those_of_the_pattern():
    texts = ["", " a\tb\x0bc ", "é\xa0x\x85y", "one", "\n"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    w = Words(data, np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))))
    got = [[bytes(data[w.start[i] : w.end[i]]).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
    assert got == [re.findall("[^\x20\x09-\x0d]+", t) for t in texts]


@pytest.fixture(scope="module")
def pair():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path()), spm.codec(queries.model_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabethonr▁<>0x​日😀é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_sentencepiece_is_the_librarys(pair, text):
    library, own = pair
    assert own.encode(text) == library.encode(text)
    assert own.decode(own.encode(text)) == library.decode(library.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
def test_decoding_any_ids_is_the_librarys(pair, ids):
    assert pair[1].decode(ids) == pair[0].decode(ids)


def test_control_ids_before_a_space_write_nothing(pair):
    for ids in ([1, 284], [1, 2, 284, 1], [0, 284], [284, 284], [1, 1], [2, 0, 284]):
        assert pair[1].decode(ids) == pair[0].decode(ids)


@pytest.mark.parametrize(("fixed", "linear"), [((0,), True), ((0, 1, 2, 3, 4), False), ((), True), ((4,), False)])
def test_flac_round_trip_and_damage(fixed, linear):
    rnd = random.Random(5)
    texts = ["", None, "x" * 64, "é" * 3000, "".join(chr(rnd.randrange(32, 1200)) for _ in range(5000)), "ab" * 90000]
    for _, _, data, first, n in flac.payloads(pa.array(texts)):
        files = flac.encode(data, first, fixed, linear)
        back, bounds, points = flac.decode(files)
        assert (back == data).all() and (bounds == first).all() and all(b - a == max(64, -(-k // 64) * 64) for a, b, k in zip(first, first[1:], n, strict=False))
        for at in (len(files[3]) - 30, len(files[3]) // 2):
            bad = bytearray(files[3])
            bad[at] ^= 16
            with pytest.raises(ValueError):
                flac.decode([bytes(bad)])


def test_flac_of_long_texts_is_the_same_in_pieces(monkeypatch):
    texts = pa.array(["ab\u00e9c " * 3000, "x", "no " * 20000])
    whole = [flac.encode(data, first) for _, _, data, first, _ in flac.payloads(texts)]
    monkeypatch.setattr(flac, "PIECE", 5)
    for (_, _, data, first, _), files in zip(flac.payloads(texts), whole, strict=True):
        assert flac.encode(data, first) == files and (flac.decode(files)[0] == data).all()
        cut = files[0][:-700]
        with pytest.raises((ValueError, IndexError)):
            flac.decode([cut])


def test_flac_blocks_and_digests(spark):
    docs = spark.createDataFrame([(1, "abc" * 900), (2, None)], "doc_id long, text string")
    blocks = sorted((r.doc_id, r.first_sample, bytes(r.pcm)) for r in flac.pcm_blocks(flac.encode_column(docs), "doc_id").collect())
    payload = ("abc" * 900).encode().ljust(2752, b"\0")
    assert b"".join(b for d, _, b in blocks if d == 1) == payload and [s for d, s, _ in blocks if d == 1] == [0, 1024, 2048]
    assert [d for d, *_ in blocks if d == 2] == [2] and flac.pcm_blocks(spark.createDataFrame([(1, None)], "doc_id long, media binary"), "doc_id").count() == 0
    got = {r.doc_id: r for r in flac.digests(docs).collect()}
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (2700, 2752, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and got[2].n_bytes == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+_1 ", max_size=40))
def test_emails_are_leftmost_matches(text):
    assert private_data.emails(text) == [m.span() for m in EMAIL.finditer(text)]


IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0125.. +", max_size=40))
def test_addresses_are_leftmost_matches(text):
    want = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert private_data.base_spans(text)["ip"] == want


def test_long_digit_runs_take_one_pass():
    assert private_data.base_spans("1." + "7" * 300_000)["ip"] == []


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write bob [at] mail [dot] example [dot] com now", "email", "bob [at] mail [dot] example [dot] com"),
        ("or bob at example dot com, please", "email", "bob at example dot com"),
        ("jоhn＠ехample.com", "email", "jоhn＠ехample.com"),
        ("call + 1", None, ""),
        ("call +1 five five five 010 4477.", "phone", "+1 five five five 010 4477"),
        ("pay ４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("at host １９２.168.0.1 ok", "ip", "１９２.168.0.1"),
        ("he is at one or two of them dot", None, ""),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    plain, more = private_data.find(text)
    assert not any(plain.values())
    assert {k: [text[a:b] for a, b in v] for k, v in more.items() if v} == ({kind: [found]} if kind else {})


def test_plain_spans_stay_and_redaction():
    text = "a@b.cc 1.2.3.4 or 4111 1111 1111 1111 or +49 (30) 1234567 and x [at] y [dot] org"
    plain, more = private_data.find(text)
    assert [len(plain[k]) for k in private_data.KINDS] == [1, 1, 1, 1] and [text[a:b] for a, b in more["email"]] == ["x [at] y [dot] org"]
    assert private_data.redact(text) == "[EMAIL] [IP] or [CARD] or [PHONE] and [EMAIL]"


@pytest.mark.parametrize(
    ("text", "kind", "plain_part"),
    [
        ("jоhn.smith@example.com", "email", "hn.smith@example.com"),
        ("john@mail.exаmple.com", "email", "john@mail.ex"),
        ("bob@mail.example [dot] com", "email", "bob@mail.example"),
        ("+49 30 1234567 five five five", "phone", "+49 30 1234567"),
        ("+49 30 12345６７", "phone", "+49 30 12345"),
    ],
)
def test_disguised_spans_beyond_a_plain_match(text, kind, plain_part):
    plain, more = private_data.find(f"to {text}, or")
    assert [f"to {text}, or"[a:b] for a, b in plain[kind]] == [plain_part]
    assert more[kind] == [(3, 3 + len(text))] and private_data.redact(f"to {text}, or") == f"to [{kind.upper()}], or"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("bob [at] example dot com", "email"),
        ("bob at example [dot] com", "email"),
        ("bob@example dot com", "email"),
        ("bob at mail.example dot com", "email"),
        ("192 dot 168 dot 0 dot 1", "ip"),
        ("192.168.zero [dot] one", "ip"),
        ("+49 30 five five 12 34 56", "phone"),
        ("+49 30 five 12 34 56", "phone"),
    ],
)
def test_mixed_disguises(text, kind):
    assert private_data.redact(f"is: {text}, or") == f"is: [{kind.upper()}], or"


def test_bare_words_that_are_no_disguise():
    for text in ("see us at example.com or six. At one, dot the i", "ſix one two İ", "2 dot 5 and one of three"):
        assert private_data.redact(text) == text


def test_a_bare_at_in_prose_stays():
    for text in ("page 1 at the dot com boom", "look at example [dot] com", "it peaked at the dot com bubble", "7 at mail dot org", "us at example dot com"):
        assert private_data.redact(text) == text
    for text in ("bob at example dot com", "b.7 at the-mail dot org", "Seen2 at example [dot] com"):
        assert private_data.redact(f"to {text}!") == "to [EMAIL]!"


def test_substitutions_are_tolerated(spark):
    rnd = random.Random(3)
    item = [f"b{i}" for i in range(30)]
    rows = []
    for d in range(40):
        w = [rnd.choice(["the", "of", "x", "y"]) for _ in range(50)]
        own = [f"z{d}" if d and k % 9 == d % 9 else t.upper() + "," for k, t in enumerate(item)]
        rows.append((d, " ".join(w[:20] + own + w[20:])))
    rows.append((99, " ".join(item[:6] + ["no"] * 9 + item[6:12])))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(range(40))


def test_every_row_of_a_key_is_judged(spark, duck):
    item = [f"b{i}" for i in range(14)]
    rows = [(7, " ".join(item)), (7, "x " * 40), (8, " ".join(["y", *item, "z"])), (9, "x " * 40), (None, " ".join(item)), (7, None)]
    bench = [(1, " ".join(item)), (2, " ".join(f"c{i}" for i in range(60))), (2, " ".join(["q", *item[1:]]))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.leaks(docs, items)
    own = duckdb.connect()
    own.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    own.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    own.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    own.executemany("INSERT INTO benchmark VALUES (?, ?)", bench)
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(own.execute(decontaminate.oracle_sql()).fetchall()) and {(d, i) for d, i, *_ in found} == {(7, 1), (7, 2), (8, 1), (8, 2)}
    assert sorted((r.doc_id or 0) for r in decontaminate.remove(docs, items).collect()) == [0, 9]


def test_benchmarks_too_large_to_broadcast(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert want and sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == want
    monkeypatch.setattr(decontaminate, "SLOTS", 64)
    monkeypatch.setattr(decontaminate, "BLOCK", 5)  # texts of many blocks
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == want


def test_columns_of_any_name_pass_the_classifier(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 0.5), (2, None, None, "z", None)], "doc_id long, text string, __text string, __score string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, quality.keep_good(docs, labels).collect())) == sorted(map(tuple, docs.collect()))


def test_long_texts_score_alike_in_pieces():
    rnd = random.Random(2)
    text = " ".join(rnd.choice(["a", "bb", "été", "hello", "the", "the", "x\n\ny", " "]) for _ in range(9000))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    weights = np.random.default_rng(0).normal(size=quality.BUCKETS)
    total, many = quality._logits(data, np.array([0, len(data)]), weights)
    for limit in (1000, 7777):
        got = quality._long_logits(data, weights, limit)
        assert got[1] == many[0] and abs(got[0] - total[0]) < 1e-6


def test_words_of_long_texts_are_whole(monkeypatch):
    from lodestone.llm import words

    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab é\n ") if rnd.random() < 0.9 else "x" * rnd.randrange(50) for _ in range(20000)) for _ in range(3)] + ["z" * 30000, "", "  "]
    data, bounds = np.frombuffer("".join(texts).encode(), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    whole = Words(data, bounds)
    monkeypatch.setattr(words, "SLICE_BYTES", 9000)
    for name in ("start", "end", "hash", "first", "doc"):
        assert (getattr(whole, name) == getattr(Words(data, bounds), name)).all()


CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0149+ -().a@x", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    def luhn(digits):
        own = [int(c) for c in reversed(digits)]
        return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    want = {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }
    assert private_data.base_spans(text) == want


def test_base_digest_is_of_the_listed_spans(spark):
    text = "é a@b.cc 1.2.3.4 or 4111 1111 1111 1111 or +49 (30) 1234567 and c@d.ee x [at] y [dot] org"
    spans = ",".join(f"{k}:{text.index(x)}:{text.index(x) + len(x)}" for k, x in (("email", "a@b.cc"), ("email", "c@d.ee"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567")))
    (row,) = private_data.scan(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, spans int")).collect()
    assert row.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and (row.n_email, row.n_ip, row.n_card, row.n_phone, row.n_disguised) == (2, 1, 1, 1, 1)
    assert "email:69:85" in row.spans or len(row.spans.split(",")) == 6


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_licence_files_and_notices(spark):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and "Permission" in t)
    rows = [(1, "intro text here\n\nReleased under the MIT licence\n"), (2, "My Project\n\nCopyright 2020 Somebody\n\n" + mit.replace(". ", ".\n")), (3, "of the and is to")]
    got = {(r.doc_id, r.unit, r.license_id) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (2, "document", "MIT") in got and (2, "paragraph", "MIT") in got and not any(d == 3 for d, _, _ in got)


def test_each_template_is_most_like_itself():
    own = licences.Templates(licences.TEMPLATES, 0.8)
    assert {n for n, _ in own.own} >= {"GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Unlicense", "Zlib", "BSL-1.0", "0BSD", "CC0-1.0"}
    for k, (name, bigrams) in enumerate(own.own):
        assert own.own[own.score(bigrams)[0]][0] == name
        fewer = frozenset(sorted(bigrams)[: int(len(bigrams) * 0.9)])
        plain = max(((2 * len(fewer & b) / (len(fewer) + len(b)), -j) for j, (_, b) in enumerate(own.own)), default=(0, 0))
        got = own.score(fewer)
        assert (got is None and plain[0] < 0.8) or (got[2], -got[0]) == plain


def test_licence_texts_of_several_paragraphs(spark):
    def laid_out(name, n, marks):
        w = max((t for k, t in licences.TEMPLATES if k == name), key=len).split()
        cuts = [len(w) * i // n for i in range(n + 1)]
        return marks.join(" ".join(w[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))

    prose = "\n\n".join(" ".join(f"w{i}x{k}" for k in range(25)) for i in range(8))
    short = "Released under the MIT License."
    rows = [(1, f"{prose}\n\n{laid_out('MIT', 3, chr(10) * 2)}\n\n{prose}"), (2, f"# a\n#\n# {laid_out('Apache-2.0', 3, chr(10) + ' * ' + chr(10))}\n#\n{prose}"), (3, "\n\n".join([prose, laid_out("BSD-3-Clause", 5, "\n\n"), laid_out("BSD-3-Clause", 4, "\n\n")]))]
    rows += [(4, f"MIT\n\n{short}\n\n{prose}"), (5, laid_out("MIT", 3, "\n\n")), (6, f"{prose}\n\n" + f"{short}\n\n" * 200)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.license_id, r.end_word - r.first_word, r.dice) for r in found if r.unit == "paragraphs")
    size = lambda name: len(licences.normalised(max((t for k, t in licences.TEMPLATES if k == name), key=len)))
    assert got == [(1, "MIT", size("MIT"), 1.0), (2, "Apache-2.0", size("Apache-2.0"), 1.0), *[(3, "BSD-3-Clause", size("BSD-3-Clause"), 1.0)] * 2]
