import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from sigdiff.llm import secret_scan as sc
from tests.llm.helpers import awkward, docs, none

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def made():
    rng = random.Random(2)
    secret = lambda n, a: "".join(rng.choices(a, k=n))
    bits = ["Password = 'hunter2secret'", "api_key:abc", "APIKEY=\"Zm9vYmFyMTIz+/==\"", "toKen  :  x.y-z_12", "AKIA" + secret(16, string.ascii_uppercase), "AKIAAKIA" + secret(4, "0123"), secret(32, "0123456789abcdef"), secret(23, "0123456789abcdef"), "été ", "\U0001f600", "passwd:\npasswd=éabcdefg", "secret=secret=token=abcdef", "ſecret=abcdefgh", "the words of this text are plain ", "toKen=abcdefgh"]
    return ["".join(rng.choices(bits + [" ", "\n", "x"], k=rng.randint(0, 12))) for _ in range(300)]


def test_base_spans_equal_brute_force(spark):
    texts = made()
    got = sc.find_secrets(docs(spark, texts)).select("doc_id", "base_sha256", sc.span_text("spans").alias("spans")).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        want = brute(text)
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in row.spans.split(",") if s and not s.startswith("random")] == want


def test_battery_is_level_on_random_symbols():
    rng = np.random.default_rng(1)
    for size in (16, 26, 64):
        p = np.array([sc.battery(rng.integers(0, size, 60), size) for _ in range(2000)])
        assert 0.01 < (p < 0.05).mean() < 0.12
    assert sc.battery(np.arange(60) % 26, 26) < 1e-6


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    words = ["thering", "nation", "onwhen", "eration", "the", "of", "ingly", "edtion", "anderer"]
    say = lambda: " ".join(rng.choices(words, k=400))
    texts, planted = [], {}
    for i in range(1500):
        text = say()
        if i % 10 == 0:
            key = "".join(rng.choices(sc.ALPHABETS["alnum"], k=48))
            planted[i] = (len(text) + 1, len(text) + 1 + 48)
            text = f"{text} {key} {say()}"
        elif i % 10 == 1:
            text += " " + "".join(rng.choices(words, k=9))
        texts.append(text)
    rows = sc.find_secrets(docs(spark, texts)).select("doc_id", F.filter("spans", lambda s: s["kind"] == 3).alias("spans")).collect()
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in rows if r.spans}
    assert sum(got.get(i) == [w] for i, w in planted.items()) >= 0.9 * len(planted)
    assert len(set(got) - set(planted)) <= 0.1 * len(planted)


def test_windows_cover_every_text(spark):
    text = "".join(random.Random(4).choices(string.ascii_letters + "  ", k=3000))
    raw = np.frombuffer(text.encode() + b"\n", np.uint8)
    null = sc.controls(raw, np.array([0, len(raw)]))
    for e, name in enumerate(sc.NAMES):
        source = text.upper() if name in ("HEX", "upper", "base32", "upper36") else text
        x = np.array([sc.ALPHABETS[name].index(c) for c in source if c in sc.ALPHABETS[name]])
        for k, n in enumerate(sc.CLASSES):
            rows = x[: len(x) // n * n].reshape(-1, n)
            own = range((e * len(sc.CLASSES) + k) * sc.BINS, (e * len(sc.CLASSES) + k + 1) * sc.BINS)
            assert sum(null.get(c, 0) for c in own) == len(rows)
            assert np.allclose(sc.batteries(rows, len(sc.ALPHABETS[name])), [sc.battery(r, len(sc.ALPHABETS[name])) for r in rows], rtol=1e-4)


def test_one_short_key_in_few_texts_is_found_also_beside_a_base_span(spark):
    rng = random.Random(3)
    words = ["thering", "nation", "onwhen", "eration", "the", "of", "ingly", "edtion", "anderer"]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(40)]
    key = "q7Xz0Lm4VtK9bWc2RjYp"
    texts[5] = f"{key} {texts[5]}"
    texts[6] = f"{'0123456789abcdef' * 2}-{key} {texts[6]}"
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in sc.find_secrets(docs(spark, texts)).collect()}
    assert got[5] == [(0, 20)] and got[6] == [(32, 53)] and sum(map(len, got.values())) == 2


def test_redaction_keeps_rows_and_columns(spark):
    d = docs(spark, ["é password=hunter22 end", None, "plain"])
    got = {r.doc_id: (r.text, r.n_chars) for r in sc.redact(d).collect()}
    assert got == {0: ("é [assign] end", 14), 1: (None, 0), 2: ("plain", 5)} and sc.redact(d).columns == d.columns


def test_awkward_and_empty_tables(spark):
    got = sc.find_secrets(awkward(spark)).collect()
    assert len(got) == 10 and {r.base_sha256 for r in got if not r.base} == {hashlib.sha256(b"").hexdigest()}
    assert sc.find_secrets(none(spark)).count() == 0 and sc.redact(none(spark)).count() == 0
    assert sc.redact(awkward(spark)).count() == 10


def test_time_grows_with_the_text_alone():
    import time

    bits = "été password=hunter22x 0123456789abcdef0123456789 q7Xz0Lm4VtK9bWc2RjYp9Q "
    took = []
    for n in (2_000, 16_000):
        began = time.perf_counter()
        base, found, _ = sc.scan([bits * n], False)
        took.append(time.perf_counter() - began)
        assert len(base[0]) == 2 * n and len(found[0]) == n and base[0][-1][1] <= len(bits) * n
    assert took[1] < 24 * took[0]


def test_candidates_beside_overlapping_base_spans():
    text = "x" * 25 + "-token=" + "0123456789abcdef" * 2 + "=" + "Q7z" * 10
    base, found, _ = sc.scan([text], False)
    assert [(a, b) for a, b, _ in base[0]] == [(26, 26 + 6 + 32 + 31), (32, 64)] and [(a, b) for a, b, _ in found[0]] == [(0, 26)]


def test_other_text_column(spark):
    d = docs(spark, ["é password=hunter22 end", None]).withColumnRenamed("text", "body").withColumn("text", F.lit(3))
    assert [(r.body, r.text) for r in sc.redact(d, text_col="body").orderBy("doc_id").collect()] == [("é [assign] end", 3), (None, 3)]


def test_false_discovery_step_equals_plain_loop(spark):
    rng = random.Random(8)
    cells = [sc.cell(e, n, 10 ** -rng.uniform(0, 9)) for e in (0, 8, 9) for n in (20, 45, 130) for _ in range(30)]
    null = {}
    for _ in range(3000):
        c = sc.cell(rng.choice((0, 8, 9)), rng.choice((20, 40, 128)), 10 ** -max(0, 8 - rng.expovariate(2)))
        null[c] = null.get(c, 0) + 1
    seen = spark.createDataFrame([([(0, 1, c) for c in cells], list(null.items()))], f"found {sc.SPAN_SQL}, windows {sc.NULL_SQL}")
    weight = [sc.CLASSES[c // sc.BINS % len(sc.CLASSES)] for c in cells]
    mean = sum(weight) / len(weight)
    p = []
    for c, w in zip(cells, weight, strict=True):
        group, b = divmod(c, sc.BINS)
        fits = {k: n for k, n in null.items() if k // sc.BINS // len(sc.CLASSES) == group // len(sc.CLASSES) and k // sc.BINS <= group}
        p.append((1 + sum(n for k, n in fits.items() if k % sc.BINS <= b)) / (1 + sum(fits.values())) * mean / w)
    limit = max((x for x in p if x <= sc.RATE * sum(y <= x for y in p) / len(p)), default=-1)
    want = {c for c, x in zip(cells, p, strict=True) if x <= limit}
    assert want and set(sc.accepted_cells(seen)) == want
