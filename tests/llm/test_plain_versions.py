"""Site quality, secrets, toxicity and the passage cut against plain Python versions."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from skysift.llm import automaton, credentials, quality, toxicity
from skysift.llm.queries import QUERIES


def plain_quality(rows):
    """Posteriors of each row by loops over all rows; sites as in the data, null ones too."""
    own = [e if label is None else float(label) for _, _, e, label in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, p, *_), o in zip(rows, own):
        hosts[h].append(o)
        paths[h, p].append(o)
    mean = sum(own) / len(own)

    def strength(groups):
        n = sum(len(v) for v, _ in groups)
        between = sum(len(v) * (sum(v) / len(v) - m) ** 2 for v, m in groups) - sum(m * (1 - m) for _, m in groups)
        variance = between / (n - sum(len(v) ** 2 for v, _ in groups) / n) if n > sum(len(v) ** 2 for v, _ in groups) / n else None
        if variance is None:
            return 10_000.0
        middle = sum(len(v) * m * (1 - m) for v, m in groups) / n
        return min(10_000.0, max(1.0, middle / max(variance, 1e-9) - 1))

    k0 = strength([(v, mean) for v in hosts.values()])
    k1 = strength([(v, sum(hosts[h]) / len(hosts[h])) for (h, _), v in paths.items()])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for (h, p, e, _), o in zip(rows, own):
        host = (k0 * mean + sum(hosts[h]) - o) / (k0 + len(hosts[h]) - 1)
        path = (k1 * host + sum(paths[h, p]) - o) / (k1 + len(paths[h, p]) - 1)
        out.append((host, path, 1 / (1 + math.exp(-(logit(e) + logit(path) - logit(mean))))))
    return out


def test_site_quality(spark):
    rng = random.Random(4)
    base = {h: rng.random() for h in ("a", "b", "c", None)}
    rows = [(h, rng.choice(["x", "y", None]), min(0.999, max(0.001, rng.gauss(base[h], 0.2))), rng.choice([None, None, 0, 1])) for h in rng.choices(["a", "a", "a", "b", "c", None], k=400)]
    rows += [("single", "z", 0.9, None), ("single", "q", 0.5, 1)]
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "i int, host string, path string, evidence double, label int, _n string").repartition(3)
    found = {r["i"]: r for r in quality.site_quality(df.drop("_n"), "host", "path", label_col="label").collect()}
    for i, (host, path, q) in enumerate(plain_quality(rows)):
        assert (found[i]["host_posterior"], found[i]["path_posterior"], found[i]["quality"]) == (pytest.approx(host, abs=1e-5), pytest.approx(path, abs=1e-5), pytest.approx(q, abs=1e-5))


def plain_spans(text):
    """All patterns over the whole text, and weak parts by comparing each with every other part."""
    tests = {
        "assign": (credentials.ASSIGN, lambda m: len(m.group(2)) >= 6), "access": (credentials.ACCESS, lambda m: len(m.group()) >= 20), "hex": (credentials.HEX, lambda m: len(m.group()) >= 24),
        "identifier": (credentials.IDENTIFIER, lambda m: True), "key": (credentials.KEY, lambda m: bool(re.search("[0-9]", m.group()) and re.search("[a-z]", m.group()) and re.search("[A-Z]", m.group()))),
        "endpoint": (credentials.ENDPOINT, lambda m: True),
    }
    parts = [(m.start(), k, m.end()) for k, name in enumerate(credentials.KINDS) for m in tests[name][0].finditer(text or "") if tests[name][1](m)]
    role = {k: credentials.ROLE[name] for k, name in enumerate(credentials.KINDS)}

    def meets(p, wanted):
        return any(role[r[1]] == wanted and p[0] < r[2] + credentials.SCOPE and r[0] < p[2] + credentials.SCOPE and (p[0] >= r[2] or r[0] >= p[2]) for r in parts)

    base = [p for p in parts if p[1] < 3]
    needs = {3: ("secret",), 4: ("identifier",), 5: ("identifier", "secret")}
    weak = [p for p in parts if p[1] >= 3 and all(meets(p, w) for w in needs[p[1]]) and not any(b[0] <= p[0] and p[2] <= b[2] for b in base)]
    return sorted([*base, *weak])


def test_secrets(spark):
    """Random texts of secrets, identifiers, endpoints and filler at all distances; several thousand code points long."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def piece():
        kind = rng.randrange(9)
        word = "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
        code = "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(rng.choice([5, 8, 32, 40])))
        return [f'{rng.choice(["password", "Api_Key", "token", "SECRET"])}{rng.choice([":", "=", " = ", "\": \""])}{code}', "AKIA" + code.upper(), "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([10, 24, 40]))),
                f"user={word}", code, f"https://{word}.example/{word}", "10.0.0.1:8080", "é漢 " * rng.randint(1, 150), " ".join([word] * rng.randint(1, 60))][kind]

    rows = [(i, " ".join(piece() for _ in range(rng.randint(0, 14)))) for i in range(300)] + [(300, None), (301, ""), (302, "AKIA" + "A" * 16), (302, "password=abcdef")]
    found = defaultdict(list)
    for r in credentials.find_credentials(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        found[r["doc_id"]].append([(s["start"], s["kind"], s["end"]) for s in r["spans"]])
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(plain_spans(t))
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in want.items()}
    assert sum(k >= 3 for v in want.values() for spans in v for _, k, _ in spans) > 50


def test_toxicity_scores(spark):
    """Scores of a fitted model from windows that are cut and compressed one by one here."""
    rng = random.Random(2)
    words = ["".join(rng.choice(["an", "er", "on", "th", "re", "st"]) for _ in range(3)) for _ in range(200)]

    def text(bad):
        out = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(4 * bad):
            out[rng.randrange(len(out))] = rng.choice(["vilifold", "scumbago"])
        return " ".join(out)

    rows = [(i, text(i % 3 == 0)) for i in range(400)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    more = spark.createDataFrame([*rows, (900, None), (901, ""), (902, " " * 500), (903, text(True) * 40)], df.schema)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(more, model, ["doc_id"]).collect()}

    for r in more.collect():
        raw = (r["text"] or "").encode()
        d = toxicity.saved(raw, toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary))
        x = np.zeros(2 + 2 * len(toxicity.STEPS))
        if len(d):
            over = [sum(1 for v in d if v >= k) for k in toxicity.STEPS]
            x[:] = [sum(d) / len(d), max(d), *(n / len(d) for n in over), *(math.log(1 + n) for n in over)]
        total = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.spread))
        assert found[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    held = [(found[i], i % 3 == 0) for i in range(300, 400)]
    assert np.mean([(s >= 0.7) == bad for s, bad in held]) > 0.9
    assert isinstance(toxicity.compressor(model.toxic), zstandard.ZstdCompressor)


def test_short_benchmark_items_are_cut(spark, tmp_path):
    """Whole items of five words or more leave the text, shorter ones and parts of a longer one stay."""
    items = [("q1", "alpha beta gamma delta epsilon"), ("q2", "north south"), ("q3", "one two three four five six seven eight nine ten eleven twelve"), (None, "lonely words of no item at all"), ("q4", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = "plain words that go on and on for quite a while without any of it being part of a test. " * 2
    docs = [(1, clean + "Alpha beta, gamma delta epsilon! " + clean), (2, clean + "north south " + clean), (3, clean + "one two three four five six seven " + clean), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.decontamination(spark, df, str(tmp_path)).collect()}
    assert "gamma" not in found[1] and found[1].startswith(clean) and found[1].endswith(clean)
    assert (found[2], found[3], found[4], found[5]) == (docs[1][1], docs[2][1], None, "")
    assert automaton.without_runs(b"a b c", [[0, 1]], 3, 5, 0.5) == "a b c"


def test_secrets_query(spark, tmp_path):
    """The query's digest columns: texts with several spans of one kind and none of another, repeated and null ids."""
    rng = random.Random(4)
    pieces = ["password=abcdef12", "token: 'x1y2z3'", "secret=abc", "AKIA" + "B7" * 10, "0123456789abcdef" * 2, "user=ann", "é漢", "plain words", "ſecret=abcdefgh", "\n"]
    texts = ["password=abcdef token=abcdef api_key=abcdef", "AKIA" + "A" * 16, "f" * 24 + " " + "e" * 30, "", None]
    texts += [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    rows = [*enumerate(texts), (0, "AKIA" + "A" * 16), (None, "passwd=abcdef")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def wanted(i, text):
        base = [s for s in plain_spans(text) if s[1] < 3]
        joined = ",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in base)
        return (i, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())

    found = QUERIES["op9_secrets"](spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert sorted(map(tuple, found), key=str) == sorted((wanted(i, t) for i, t in rows), key=str)
