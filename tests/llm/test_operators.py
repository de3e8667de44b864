"""The training-data operators against brute force, exact round trips and held-out rows, with odd rows in every table."""

from __future__ import annotations

import datetime
import hashlib
import itertools
import os
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlattice.llm import bitpack, decontam, jaccard_tgm, license_scan, pii_fpe, quality_fm, seqpack, tokens, topk_ip, toxicity, url_filter
from barlattice.llm.queries import PII_KEY, URL_RULES, VOCABULARY, tokenizer

rng = random.Random(5)
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "vo", "si") for c in ("", "n", "rd", "lle")]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(30_000)
#: null, empty, white space, one word, repeated rows, repeated id with other text, a very long text, a null id
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "same text twice over"), (5, "same text twice over"), (6, "an id"), (6, "the same id again"), (7, LONG), (None, "no id here"), (8, "é ß 漢字 \u00a0x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names clash with those the operators make."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("score", "label", "row", "n", "rep", "set", "ids", "host", "w", "_row", "digest", "part", "stated", "key", "pii"):
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# 1. URL rules

def judged(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_urls(spark):
    parts = [("http://", "HTTPS://", "x"), ("a.example.net", "example.net", "EXAMPLE.com", "org", "b.org", "badnet", "net", ""), ("", "/", "/en/", "/en", "/de/x", "/fr/?q", "?en/", "#/en/", "/fr/a://net/")]
    urls = ["".join(p) for p in itertools.product(*parts)] + [None, "", "://net/", "no scheme"]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, URL_RULES).collect()}
    assert got == {i: judged(u, URL_RULES) for i, u in enumerate(urls * 2)}
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, [], default="block").collect()} == {"block"}
    many = URL_RULES + [(f"h{i}.test", "/", "block") for i in range(300)] + [("net", "/", "allow")]
    small = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, many, max_image_bytes=2000).collect()}
    assert small == got  # many images; block stands against an equal allow


def test_url_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s) % 3)
    rules = [(f"host{i}.net", f"/{i}/", "block" if i % 2 else "allow") for i in range(50)]
    (tmp_path / "image").write_bytes(url_filter.build_image(rules))
    array = url_filter.DigestArray(str(tmp_path / "image"))
    keys = [f"{h}\0{p}".encode() for h, p, _ in rules] + [b"other\0/", b"host1.net\0/2/"]
    found = array.find(keys)
    assert [array.key(i) for i in found[:50]] == keys[:50] and (found[50:] == -1).all()
    assert [bool(array.blocks[i]) for i in found[:50]] == [v == "block" for _, _, v in rules]


# 2. and 6. classifiers

def test_quality(spark, odd, none):
    r = random.Random(1)
    good = [(i, prose(r.randrange(20, 200), r), 1) for i in range(300)]
    bad = [(1000 + i, " ".join([r.choice(WORDS).upper() + "!!"] * 3 + [r.choice(WORDS) + "$$$" for _ in range(60)]), 0) for i in range(100)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in good + bad], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (3, None), (99_999, 1)], "doc_id long, quality int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    sample = quality_fm.labelled_sample(labels, "quality", learn, 150)
    assert sample.groupBy("label").count().agg(F.max("count")).first()[0] <= 150
    model = quality_fm.fit(docs, sample)
    held = quality_fm.score(docs, model).join(labels.filter(~learn), "doc_id").select("score", "quality").collect()
    assert np.mean([(s >= 0.7) == (y == 1) for s, y in held]) > 0.97
    scored = quality_fm.score(odd, model, stated=None)
    assert scored.count() == len(ODD) and scored.filter(~F.col("score").between(0, 1) | F.isnan("score")).count() == 0
    assert len({x["score"] for x in scored.filter("doc_id = 5").collect()}) == 1
    assert quality_fm.score(none, model, stated=None).count() == 0
    assert quality_fm.fit(docs, sample.limit(0)).bias == 0.0
    assert quality_fm.predict(*_strings(["x"]), quality_fm.fit(docs, sample.filter("label = 1")))[0] > 0.99


def _one_text(spark, label):
    """One text throughout, so that a score can only be the share of the labels, here six sevenths."""
    data = [(i, "kata lovo mine", int(i % 7 > 0)) for i in range(1400)]
    return spark.createDataFrame([x[:2] for x in data], "doc_id long, text string").withColumn("weight", F.lit("x")), spark.createDataFrame([(x[0], x[2]) for x in data], f"doc_id long, {label} int")


def test_quality_of_a_capped_sample(spark):
    """A bound that cuts one class only leaves scores on the scale of all labels."""
    docs, labels = _one_text(spark, "quality")
    for cap in (2000, 150):
        model = quality_fm.fit(docs, quality_fm.labelled_sample(labels, "quality", F.lit(True), cap), stated=None)
        assert quality_fm.predict(*_strings(["kata lovo mine"]), model)[0] == pytest.approx(6 / 7, abs=0.05)


def _strings(texts):
    import pyarrow as pa

    return pa.array(texts, pa.large_string()), np.full(len(texts), np.nan)


def test_sum_of_squares_identity():
    r = np.random.default_rng(0)
    size = quality_fm.BUCKETS + len(quality_fm.STATS)
    m = quality_fm.Model(0.3, r.normal(size=size), r.normal(size=(size, 3)), np.zeros(len(quality_fm.STATS)), np.ones(len(quality_fm.STATS)))
    rows_, buckets, value, stats = quality_fm.features(*_strings(["a b c a", "", "d"]))
    z, _ = quality_fm._sums(rows_, buckets, value, stats, m)
    for d in range(3):
        x = np.zeros(size)
        np.add.at(x, buckets[rows_ == d], value[rows_ == d])
        x[quality_fm.BUCKETS:] = stats[d]
        at = np.flatnonzero(x)
        pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i, j in itertools.combinations(at, 2))
        assert z[d] == pytest.approx(m.bias + m.w @ x + pairs)


def test_toxicity(spark, odd, none):
    r = random.Random(2)
    data = []
    for i in range(500):
        w = prose(r.randrange(10, 300), r).split()
        if i % 4 == 0:
            w.insert(r.randrange(len(w)), r.choice(["zugh", "brakk", "Zughord", "brakkal"]))
        data.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in data], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, quality_fm.labelled_sample(labels, "toxic", ~held, 1000))
    got = toxicity.score(docs, model).join(labels.filter(held), "doc_id").select("score", "toxic").collect()
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in got]) > 0.97
    scored = toxicity.score(odd, model)
    assert scored.count() == len(ODD) and scored.filter(~F.col("score").between(0, 1)).count() == 0
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(docs, quality_fm.labelled_sample(labels, "toxic", ~held, 1000).limit(0)).bias == 0.0


def test_ratios_and_scores_equal_plain_counts(spark):
    """Which n-grams enter by counting in Python; scores as sums over a text's distinct n-grams."""
    r = random.Random(9)
    data = [(i, " ".join([*prose(r.randrange(3, 40), r).split(), *(["zugh", "brakk"] if i % 3 == 0 else ["ludo"])]), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(x[0], x[2]) for x in data], "doc_id long, toxic int")
    model = toxicity.fit(docs, quality_fm.labelled_sample(labels, "toxic", F.lit(True), 1000), features=40)
    held = {i: set(np.concatenate([h for h, _ in toxicity.grams([t])]).tolist()) for i, t, _ in data}
    counts = {}
    for i, _, y in data:
        for g in held[i]:
            counts.setdefault(g, [0, 0])[y] += 1
    key = {g: (np.log((p + 1) / 31) - np.log((q + 1) / 61)) * np.sqrt(p + q) for g, (q, p) in counts.items() if p + q >= 4}
    signed = lambda g: int(np.array(g, np.uint64).view(np.int64))
    want = set(sorted((g for g in key if key[g] > 0), key=lambda g: (-key[g], signed(g)))[:40])
    kept, edge = set(model.grams.tolist()), min(key[g] for g in want)
    assert len(kept) == 40 and all(abs(key[g] - edge) < 1e-9 for g in kept ^ want)
    weight = dict(zip(model.grams.tolist(), model.weight.tolist(), strict=True))
    for row in toxicity.score(docs, model).collect():
        z = model.bias + sum(weight[g] for g in held[row["doc_id"]] & kept)
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_of_a_capped_sample(spark):
    """A bound that cuts one class only leaves scores on the scale of all labels."""
    docs, labels = _one_text(spark, "toxic")
    full, cut = (toxicity.fit(docs, quality_fm.labelled_sample(labels, "toxic", F.lit(True), cap)) for cap in (2000, 200))
    assert full.bias > 0.5 and cut.bias == pytest.approx(full.bias, abs=0.01)


def test_grams():
    """Windows inside words, with a blank at either side at most."""
    def brute(t, n):
        out = []
        for w in re.findall(r"[^\W_]+", t.lower()):
            w = f" {w} "
            out += [w[i:i + n] for i in range(len(w) - n + 1)]
        return sorted(out)

    for text in ("Ab cde  fghijkl", "x", "", "éß-abc1"):
        for n, (h, d) in zip(toxicity.ORDERS, toxicity.grams([text]), strict=False):
            assert len(h) == len(brute(text, n)), (text, n)
            assert len(np.unique(h)) == len(set(brute(text, n)))


# 3. decontamination

def contaminated(text, items, size=10):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or "")) if x]
    hit, ids = set(), set()
    for item, t in items:
        v = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) if x]
        for s in range(max(len(v) - size + 1, 1) if v else 0):
            win = v[s:s + size]
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, odd, none):
    r = random.Random(3)
    items = [(i, prose(r.randrange(8, 25), r)) for i in range(12)] + [(20, None), (21, "..."), (22, "kata lovo"), (None, prose(14, r)), (23, "kata " * 12)]
    docs = [(i, prose(r.randrange(0, 60), r) + " " + (" ".join((r.choice(items)[1] or "").split()[r.randrange(4):]).upper() + ", ") * r.randrange(3) + prose(9, r)) for i in range(60)]
    docs += [(100, "kata " * 40), (101, "Kata-LOVO"), *[(i, t) for i, t in ODD if t is not LONG]]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("h", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, *contaminated(t, items)) for i, t in docs], key=str)
    for limit in (200_000, 0):  # broadcast and shuffled
        got = rows(decontam.scan(a, b, max_broadcast_windows=limit), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == want
    assert decontam.scan(none, b).count() == 0
    assert {x["contaminated"] for x in decontam.scan(odd, b.limit(0)).collect()} == {False}
    plan = decontam.scan(a, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 4. and 10. tokens

TEXTS = [t or "" for _, t in ODD[:8]] + ["  a  b ", "x\n\n y <|endoftext|> z<|endoftext|>", "don't  it's 'll x\t y", "a \x1cb  c", "a \u00a0b", "1234 5,678.9!!  ", LONG[:5000]]


def test_encoder_equals_library():
    e = tokens.Encoder(tokenizer(), cache_entries=50)
    for texts in (TEXTS, TEXTS[::-1], [prose(50) for _ in range(30)]):
        assert e.encode_bytes(texts) == e._library(texts)


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bits(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    packed = bitpack.pack_bits(ids, width)
    assert len(packed) == -(-len(ids) * width // 8) and (bitpack.unpack_bits(packed, len(ids), width) == ids).all()
    with pytest.raises(ValueError):
        bitpack.pack_bits(np.array([1 << width if width < 32 else 1 << 33], np.uint64), width)


def test_width():
    assert [bitpack.width_of(v) for v in (0, 1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 1, 2, 16, 16, 17]


def test_token_files(spark, odd, none, tmp_path):
    e = tokens.Encoder.of(tokenizer())
    want, start = [], 0
    for i, t in sorted(ODD, key=lambda x: (-(1 << 63) if x[0] is None else x[0], x[1] or "")):
        ids = e.encode_bytes([t or ""])[0] + bytes(4)
        want.append((-(1 << 63) if i is None else i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    for vocabulary, block, per_file in ((VOCABULARY, 64, 500), (100_000, 8192, 1 << 20)):
        manifest = bitpack.write_tokens(odd, f"file://{tmp_path}/{vocabulary}", tokenizer(), vocabulary, block=block, file_ids=per_file)
        assert rows(bitpack.read_tokens(manifest), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    whole = bitpack.read_tokens(manifest, with_ids=True).collect()
    assert all(zlib.crc32(x["ids"]) == x["ids_crc32"] for x in whole)
    assert bitpack.read_tokens(bitpack.write_tokens(none, f"file://{tmp_path}/none", tokenizer(), VOCABULARY)).count() == 0


def test_packing(spark, odd, none):
    texts = ODD + [(100 + i, prose(rng.randrange(1, 900))) for i in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("start", F.lit("x"))
    e = tokens.Encoder.of(tokenizer())
    for group in (4096, 1 << 20):
        got = seqpack.pack(df, tokenizer(), group_tokens=group).collect()
        want = sorted((str(i), e.encode_bytes([t or ""])[0] + bytes(4)) for i, t in texts)
        by = {}
        for r in got:
            assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"] and 0 < r["length"] <= 1024
            by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        again = []
        for (i, n), parts in by.items():
            at = b""
            for start, ids in sorted(parts):  # repeated rows bring each piece twice
                if start * 4 == len(at) % (4 * n):
                    at += ids
            again.append((str(i), at))
        assert sum(len(b) for _, b in again) >= sum(len(b) for _, b in set(want))
        assert sum(r["length"] for r in got) == sum(len(b) // 4 for _, b in want)
        seqs = {}
        for r in got:
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in seqs.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at == 1024 or at & (at - 1) == 0
    assert seqpack.pack(none, tokenizer()).count() == 0


def test_packing_balances_cost():
    """Full sequences cost about the same, while filling one after another in descending order gives very unlike ones."""
    lengths = [rng.randrange(1, 400) for _ in range(900)]
    pieces = seqpack.place(lengths, 1024, 1.0, 1 / 1024)
    assert sum(p[2] for p in pieces) == sum(lengths)
    cost, size = {}, {}
    for _, _, n, s, _ in pieces:
        cost[s], size[s] = cost.get(s, 0) + n + n * n / 1024, size.get(s, 0) + n
    full, at, plain = [v for s, v in cost.items() if size[s] == 1024], 0, {}
    for n in sorted(lengths, reverse=True):
        while n:
            take = min(n, 1024 - at % 1024)
            plain[at // 1024] = plain.get(at // 1024, 0) + take + take * take / 1024
            at, n = at + take, n - take
    assert np.std(full) < 0.5 * np.std(list(plain.values()))


# 5. pseudonyms

def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def test_feistel_permutes():
    f = pii_fpe.Feistel(b"k")
    for n in (1, 2, 3, 10, 97, 1000):
        out = [f.permute(x, n, "t") for x in range(n)]
        assert sorted(out) == list(range(n)) and [f.permute(y, n, "t", inverse=True) for y in out] == list(range(n))


VALUES = [("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("date", "1987-02-28"), ("date", "31.12.1999"), ("date", "29/02/2000"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
          ("email", "jo.81@mail.example.com"), ("phone", "+1 (714) 555-9345"), ("phone", "(714) 555-9345"), ("ssn", "123-45-6789"), ("ipv4", "10.0.255.1"), ("secret", 'token = "b44e15e09fd311c3cf31')]


@pytest.mark.parametrize("kind,value", VALUES)
def test_pseudonym_keeps_format(kind, value):
    names = pii_fpe.Pseudonyms(b"k")
    new = names.of(kind, value)
    assert new != value and names.back(kind, new) == value and pii_fpe.Pseudonyms(b"other").of(kind, value) != new
    if kind != "ipv4":
        assert re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", new)) == re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", value))
    if kind == "card":
        assert luhn(new)
    if kind == "date":
        datetime.date(*(map(int, new.split("-") if "-" in new else re.split(r"[./]", new)[::-1])))


def test_pseudonyms(spark, odd, none):
    text = "Mail jo.81@mail4.example.com, call +1 (714) 555-9345; of 4080250821787625 on 2020-02-29."
    left = "Version 2.0, 4080250821787626, 999.1.1.1, 2020-13-01, 12-34, a@b, 1.2.3.4.5 and 3 * 4 + (5)"
    df = spark.createDataFrame([(1, text), (2, "x " * 3 + text.upper()), (3, left), (4, None), (5, "")], "doc_id long, text string").withColumn("pii", F.lit("x"))
    got = {r["doc_id"]: r for r in pii_fpe.pseudonymise(df, PII_KEY).collect()}
    assert got[1]["pii"] == {"email": 1, "phone": 1, "card": 1, "date": 1}
    card = re.search(r"of (\d{16})", got[1]["text"])[1]
    assert luhn(card) and card in got[2]["text"] and "4080250821787625" not in got[1]["text"] + got[2]["text"]
    assert got[3]["text"] == left and got[3]["pii"] == {} and got[4]["text"] is None and got[5]["text"] == ""
    again = pii_fpe.pseudonymise(odd, PII_KEY)
    assert rows(again, "doc_id", "text") == sorted([tuple(x) for x in ODD], key=str) and set(again.columns) == set(odd.columns)
    assert pii_fpe.pseudonymise(none, PII_KEY).count() == 0


@pytest.mark.parametrize("kind,value,before,behind", [
    ("card", "4111111111111111", "", " 12/25"), ("card", "4111 1111 1111 1111", "no. 12 ", "."), ("card", "4111-1111-1111-1111", "", "-1225"), ("card", "4111 1111 1111 1111", "AB12 ", " x"),
    ("iban", "ES9121000418450200051332", "", " BIC CAIXESBB"), ("iban", "ES91 2100 0418 4502 0005 1332", "", " ABCDEF x"), ("iban", "ES9121000418450200051332", "", " 2024"),
    ("date", "03/25/2021", "on ", ", then"), ("phone", "+49 30 1234 5678", "", " 9012 3456"), ("email", "jo.81@mail.example.com", "...", "")])
def test_pseudonyms_with_neighbours(kind, value, before, behind):
    names = pii_fpe.Pseudonyms(b"k")
    new, counts = pii_fpe.replace(before + value + behind, names)
    got = new[len(before):len(before) + len(value)]
    assert counts == {kind: 1} and value not in new and new.startswith(before)
    if kind != "phone":
        assert new == before + got + behind and got == names.of(kind, value) and names.back(kind, got) == value


def test_pseudonyms_side_by_side():
    names = pii_fpe.Pseudonyms(b"k")
    new, counts = pii_fpe.replace("+1 (826) 555-4081 190.137.223.204 x", names)
    assert counts == {"phone": 1, "ipv4": 1} and new == f"{names.of('phone', '+1 (826) 555-4081')} {names.of('ipv4', '190.137.223.204')} x"


def test_month_first_dates():
    """Pseudonyms stay dates that are none with the day first, so they go back."""
    names = pii_fpe.Pseudonyms(b"k")
    for value in ("01/13/1900", "02/29/2000", "12/31/2099"):
        new = names.of("date", value)
        assert int(new[:2]) <= 12 < int(new[3:5]) and names.back("date", new) == value
    assert names.of("date", "02/30/2001") is None and names.of("date", "13/13/2001") is None


# 7. licences

def test_licenses(spark, odd, none):
    mit = dict(reversed(license_scan.KNOWN[:]))["MIT"]
    full = next(b for i, b in license_scan.KNOWN if i == "MIT" and len(b) > 500)
    docs = [(1, full), (2, "Copyright (c) 2020 Somebody\nAll rights reserved.\n" + full.upper().replace("LICENSE", "LICENCE")), (3, "text\n  released under the MIT LICENCE\nmore"),
            (4, full + " and more"), (5, "© 2020"), (6, mit + "\n" + "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0"), *ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("whole", F.lit(1))
    known = license_scan.known_digests(spark)
    for limit in (100_000, 0):
        got = rows(license_scan.scan(df, known, max_broadcast_rows=limit).filter("doc_id < 7 or doc_id is null"), "doc_id", "is_license", "n_lines", "license_ids")
        plain = [(i, False, 0, "") for i, _ in ODD if i is None or i < 7]
        want = [(1, True, 0, "MIT"), (2, True, 0, "MIT"), (3, False, 1, "MIT"), (4, False, 0, ""), (5, False, 0, ""), (6, False, 3, "CC-BY-NC-4.0,MIT")]
        assert [r for r in got if r in want] == sorted(want, key=str) or set(want) <= set(got)
        assert got == sorted(want + plain, key=str)
    assert license_scan.scan(none, known).count() == 0
    assert license_scan.scan(odd, known.limit(0)).filter("is_license or n_lines > 0").count() == 0
    assert "Python" not in license_scan.scan(df, known)._jdf.queryExecution().toString()


def test_license_files(spark):
    """Whole files as they are published: title, copyright and wrapped lines, one of which starts with the word itself."""
    folder = os.path.join(os.path.dirname(license_scan.__file__), "licenses")
    mit, isc = (next(" ".join(b.split()) for i, b in license_scan.KNOWN if i == k and len(b) > 500) for k in ("MIT", "ISC"))
    files = [("MIT", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + textwrap.fill(mit, 78)), ("MIT", "The MIT License (MIT)\n\nCopyright 2020 Some Body\n\n" + textwrap.fill(mit, 60)),
             ("ISC", "ISC License\n\nCopyright (c) 2020, Some Body\n\n" + isc.replace("above copyright", "above\ncopyright")), ("MIT", mit.replace("COPYRIGHT HOLDERS BE", "\nCOPYRIGHT HOLDERS BE"))]
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            text = f.read()
        files += [(name[:-4], text), (name[:-4], textwrap.indent(text, " * ", lambda _: True))]
        if name.startswith("BSD"):
            files.append((name[:-4], "BSD " + name[4] + "-Clause License\n\nCopyright (c) 2020, Some Body\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(p, 79) for p in text.split("\n\n"))))
        if name.startswith("Apache"):
            files.append((name[:-4], text.replace("[yyyy] [name of copyright owner]", "2020 Some Body")))
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(files)] + [(1000 + k, t[:-100]) for k, (_, t) in enumerate(files)], "doc_id long, text string")
    got = {r["doc_id"]: (r["is_license"], r["license_ids"]) for r in license_scan.scan(df, license_scan.known_digests(spark)).collect()}
    assert {k: got[k] for k in range(len(files))} == {k: (True, i) for k, (i, _) in enumerate(files)}
    assert not any(v[0] for k, v in got.items() if k >= 1000)


# 8. Jaccard join

def jaccard_components(docs, n, num, den):
    sets = []
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) if x]
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(docs))


def edited(words, edits, r):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = r.choice(WORDS) + "x"
    return words


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard(spark, n, num):
    r = random.Random(num)
    passage = prose(60, r)
    docs = []
    for _ in range(12):  # chains of edits: neighbours link, ends don't
        w = [r.choice(WORDS) for _ in range(r.randrange(8, 160))]
        for _ in range(6):
            docs.append(" ".join(w))
            w = edited(w, r.randrange(3), r)
    base = [r.choice(WORDS) for _ in range(120)]
    docs += [" ".join(edited(base, 1 + k % 4, r)) for k in range(60)]  # near copies of a text that is not there
    docs += [passage + " " + prose(r.randrange(5, 40), r) for _ in range(40)]  # a passage that many share
    docs += [" ".join([passage] * k) for k in (1, 2, 3)] + ["one", "One", "one two", "one  TWO", "", " ", None, *[" ".join(map(str, range(k, k + 10 + k % 3))) for k in range(12)]]
    docs = list(enumerate(docs))
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("label", F.lit("x")).repartition(3)
    assert rows(jaccard_tgm.near_duplicates(df, n, num), "doc_id", "n_shingles", "component_id") == sorted(jaccard_components(docs, n, num, 100), key=str)


def test_jaccard_odd(spark, odd, none):
    got = rows(jaccard_tgm.near_duplicates(odd), "doc_id", "component_id")
    assert got == sorted([(i, i) for i, _ in ODD], key=str)
    assert jaccard_tgm.near_duplicates(none).count() == 0
    linked = spark.createDataFrame([(None, "a b c d e f"), (9, "A b c d e f"), (None, "x y z")], "doc_id long, text string")
    assert rows(jaccard_tgm.near_duplicates(linked), "doc_id", "component_id") == sorted([(None, 9), (9, 9), (None, None)], key=str)


def test_jaccard_opens_foreign_groups(spark):
    """Links between hub groups are found by the matrix: two clusters joined by a document between them."""
    r = random.Random(9)
    w = [r.choice(WORDS) + str(k) for k in range(300)]
    docs = []
    for k in range(40):
        docs.append((k, " ".join(w)))
        w = edited(w, 2, r)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard_tgm.near_duplicates(df, 3, 90), "doc_id", "n_shingles", "component_id") == sorted(jaccard_components(docs, 3, 90, 100), key=str)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (101, 90), (102, 101), (5, 5)]
    got = {x["node"]: x["label"] for x in jaccard_tgm.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 90 for k in (90, 100, 101, 102))


# 9. inner products

def brute_top(vectors, asked, k):
    out = []
    clean = [(i, [float(np.floor(256 * np.float64(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in clean if asked(i)}):
        a = min(v for i, v in clean if i == q)
        s = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in clean if i != q)[:k]
        out += [(q, n + 1, i, int(-p)) for n, (p, i) in enumerate(s)]
    return sorted(out)


def test_top_products(spark):
    r = np.random.default_rng(4)
    vectors = [(i, (r.normal(size=6) * (1 + i % 5)).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(400 + i, [1.0] * 6) for i in range(40)] + [(500, None), (501, [None] * 6), (502, [float("nan")] + [1.0] * 5), (503, [float("inf")] * 6), (504, [2.0]), (505, []), (None, [9.0] * 6), (50, [1.0] * 6), (600, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("x", F.lit(1)).repartition(4)
    want = brute_top(vectors, lambda i: i % 50 == 0, 5)
    for block, head in ((16_384, 2048), (3, 10)):
        got = sorted(tuple(x) for x in topk_ip.top_k(df, F.col("vec_id") % 50 == 0, head=head, query_block=block).select("query_id", "rank", "vec_id", "score").collect())
        assert got == want
    assert topk_ip.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk_ip.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 256)]
