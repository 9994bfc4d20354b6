import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from barloom.llm import secrets
from pyspark.sql import functions as F

from .corpus import frame

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def brute(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def texts():
    r = random.Random(5)
    out = ["", None, "plain words only", "password=short", 'TOKEN = "abcdefghijkl"', "secret: token: abcdefghijklmno", "api_key:0123456789abcdef0123 AKIA" + "Z" * 14]
    out += ["é😀 ñ apikey='ABCDEFGHIJKLMNOP' é 0123456789abcdef0 x AKIAABCDEFGHIJKLMN", "AKIA12AKIA" + "B" * 20, "f" * 40 + " " + "0" * 16, "passwd" * 50 + "=abcdefabcdefabcdef12"]
    parts = ["password", "=", ":", " ", '"', "token", "api_key", "AKIA", "AB12CD34", "deadbeef", "0f1e2d3c", "é", "😀", "-", "/", "Secret", "zz", "\n"]
    out += ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(300)]
    return out


def test_base_spans_equal_the_patterns(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [tuple(s) for s in got[i].base] == brute(t or ""), t
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))


def test_battery_finds_random_runs_and_leaves_words(spark):
    r = random.Random(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["x9" + "".join(r.choice(b64) for _ in range(n)) for n in (24, 40, 64, 200)]
    plain = ["a1" + "abab" * 30, "keitlichenlichkeitbeungschaft", "path/to/the/house/of/the/words", "0000000011111111aaaaaaaa" * 4, "12345678901234567890123"]
    rows = [(i, f"see {t} here") for i, t in enumerate(keys + plain)]
    got = {x.doc_id: [s["kind"] for s in x.spans] for x in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random" in got[i] for i in range(4)) >= 3
    assert not any("random" in got[i] for i in range(4, 9))


def test_redaction_and_awkward_tables(spark):
    rows = [(1, "a password=0123456789abcdef01 b", None, "s", 31, 1, "x"), (2, None, "en", None, None, 2, ""), (3, "clean", "en", "s", 5, 3, "y")]
    df = frame(spark, rows)
    out = {r.doc_id: r for r in secrets.redacted(df).collect()}
    assert out[1].text == "a [SECRET] b" and out[1].n_chars == 12 and out[2].text is None and out[3].text == "clean"
    assert secrets.redacted(df).columns == df.columns
    assert secrets.redacted(frame(spark, [])).collect() == []


def test_spelling(spark):
    df = secrets.secret_spans(spark.createDataFrame([(1, "AKIA" + "Q7" * 8)], "doc_id long, text string"))
    row = df.select(secrets.spelled(F.col("base")).alias("s"), F.sha2(secrets.spelled(F.col("base")).cast("binary"), 256).alias("h")).first()
    assert row.s == "access:0:20" and row.h == hashlib.sha256(b"access:0:20").hexdigest()


@pytest.mark.parametrize("text", ["", "x" * 50])
def test_no_spans(spark, text):
    df = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert df.first().spans == []


def _tail(z):
    z = min(8.0, max(-8.0, z))
    return 1 / (1 + math.exp(1.5976 * z + 0.070566 * z**3))


def plain_battery(token):
    """The two p-values with numpy, and the class of a run."""
    letters = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz"}
    letters |= {"base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    tries = [("hex", "[0-9a-f]+|[0-9A-F]+"), ("base32", "[A-Z2-7]+"), ("base36", "[0-9a-z]+|[0-9A-Z]+"), ("base62", "[0-9A-Za-z]+"), ("base64", "[0-9A-Za-z+/]+|[0-9A-Za-z_-]+")]
    name = next((n for n, pattern in tries if re.fullmatch(pattern, token)), None)
    if name is None or not re.search("[0-9]", token) or not re.search("[A-Za-z]", token):
        return None
    one = token.lower() if name in ("hex", "base36") else token.replace("-", "+").replace("_", "/")
    k, n = len(letters[name]), len(one)
    code = np.array([letters[name].index(c) + 1 for c in one], dtype=float)
    squares = float((np.unique(code, return_counts=True)[1] ** 2).sum())
    chi2, spread = squares * k / n - n, 2 / (9 * (k - 1))
    p = [_tail(((max(chi2, 0) / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))]
    high = code > k / 2
    n1 = int(high.sum())
    mu = 2 * n1 * (n - n1) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    p.append(2 * _tail(abs((high[1:] != high[:-1]).sum() + 1 - mu) / math.sqrt(max(var, 1e-9))) if 0 < n1 < n and var > 0 else 1e-6)
    lag = float(((code[:-1] - (k + 1) / 2) * (code[1:] - (k + 1) / 2)).sum())
    p.append(2 * _tail(abs(lag) / ((k * k - 1) / 12 * math.sqrt(n - 1))))
    x = -sum(math.log(max(min(v, 1), 1e-12)) for v in p)
    rate = max(0.05, 2 / k)
    few = _tail((n * (n - 1) * rate - (squares - n)) / math.sqrt(2 * n * (n - 1) * (rate + (2 * (n - 2) * 1.4 - (2 * n - 3)) * rate**2)))
    kinds = ["d" if c.isdigit() else "U" if c.isupper() else "l" for c in re.sub("[-+/_]", "", token)]
    m = len(kinds) - 1
    turns = sum(a != b and (a, b) != ("U", "l") for a, b in zip(kinds, kinds[1:]))
    many = _tail((turns - m * 0.15) / math.sqrt(m * 0.15 * 0.85)) if m > 0 else 1
    y = -math.log(max(few, 1e-15)) - math.log(max(many, 1e-15))
    return name, min(int(math.log2(n)), 12), math.exp(-x) * (1 + x + x * x / 2), math.exp(-y) * (1 + y)


def planted(seed=3, keys=120, names=400):
    """Random keys of several alphabets and lengths, and ordinary names with numbers in them."""
    r = random.Random(seed)
    letters = ["0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    key = ["a7" + "".join(r.choice(letters[i % 4]) for _ in range(r.choice([18, 24, 32, 40, 64]))) for i in range(keys)]
    key = [k.upper() if i % 4 == 1 else k for i, k in enumerate(key)]
    stem = ["version", "Chapter", "user_name", "item", "getElement", "section-part", "report", "TABLE", "readme", "path/to/file", "invoice", "release-notes"]
    name = [r.choice(stem) + r.choice(["", "-", "_"]) + r.choice(["2024", "20240101", "v1", "007", "12345678", "1999-2000", "3b"]) + r.choice(["", "final", "_copy", "Draft"]) for _ in range(names)]
    return key, [n for n in dict.fromkeys(name) if len(n) >= 12]


def test_battery_equals_numpy_and_the_rule_its_cut_offs(spark):
    key, name = planted()
    tokens = list(dict.fromkeys(key + name + ["12345678901234a", "aB3-aB3-aB3-aB3", "A1" * 4000]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "doc_id long, token string")
    run = F.array(F.struct(F.lit(0).alias("start"), F.char_length("token").alias("stop"), F.col("token").alias("token")))
    got = {x.doc_id: x.b for x in df.select("doc_id", secrets.battery(run).alias("b")).collect()}
    want = [plain_battery(t) for t in tokens]
    for i, w in enumerate(want):
        assert bool(got[i]) == (w is not None), tokens[i]
        if w:
            b = got[i][0]
            assert (b.encoding, b.length_class) == w[:2]
            assert b.p_random == pytest.approx(w[2], rel=1e-6, abs=1e-12) and b.p_ordinary == pytest.approx(w[3], rel=1e-6, abs=1e-12)
    cuts = {}
    for w in want:
        if w and w[2] >= secrets.ALPHA:
            cuts.setdefault(w[:2], []).append(min(int(-math.log10(max(w[3], 1e-30)) * 50), 1000))
    expected = set()
    for group, bins in cuts.items():
        bins.sort(reverse=True)
        ok = [b for i, b in enumerate(bins) if 10 ** (-b / 50) <= (len([c for c in bins if c >= b])) * secrets.FDR / len(bins)]
        expected |= {(*group, min(ok))} if ok else set()
    assert set(secrets.random_bins(df.select("doc_id", F.concat(F.lit("see "), "token").alias("text")))) == expected


def test_tail_is_near_the_normal(spark):
    z = [-7.0, -3.0, -1.0, 0.0, 0.5, 1.96, 3.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    for v, p in df.select("z", secrets._tail(F.col("z"))).collect():
        assert abs(p - 0.5 * math.erfc(v / math.sqrt(2))) < 2e-4


def test_planted_keys_are_found_and_names_left_alone(spark):
    key, name = planted()
    rows = [(i, f"see {t} here, é and {t}.") for i, t in enumerate(key + name)]
    found = {x.doc_id for x in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if any(s["kind"] == "random" for s in x.spans)}
    true = {i for i in found if i < len(key)}
    assert len(true) >= 0.9 * len(key) and len(found) - len(true) <= 0.05 * len(found)


def test_long_texts_take_time_in_proportion(spark):
    r = random.Random(1)
    hexes = " ".join("".join(r.choice("0123456789abcdef") for _ in range(17)) for _ in range(100_000))
    keys = " ".join("x9" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(13)) for _ in range(3_000))
    df = spark.createDataFrame([(1, hexes), (2, keys)], "doc_id long, text string").repartition(2)
    began = time.perf_counter()
    got = {x.doc_id: x for x in secrets.redacted(df.withColumn("spans", F.lit("kept"))).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].text == " ".join(["[SECRET]"] * 100_000) and got[1].spans == "kept"
