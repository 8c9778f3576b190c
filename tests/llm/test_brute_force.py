"""The log's fold, the ordinal likelihood and the decoding of codes against plain versions."""

import math
import random

import numpy as np

from geoloom.llm import chat, langid, quality

LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def folded(log):
    """The messages of a log, event by event."""
    out = {}
    for conv, _, message, kind, role, text in sorted(log, key=lambda e: (e[0], e[1])):
        if kind == "regenerate":
            for later in [m for c, m in out if c == conv and m > message]:
                del out[conv, later]
        m = out.setdefault((conv, message), {"role": "", "text": "", "gone": False})
        m["role"] = role or m["role"]
        if kind == "delta":
            m["text"] += text or ""
        else:
            m |= {"text": (text or "") if kind in ("message", "edit") else "", "gone": kind == "delete"}
    return {k: (m["role"], m["text"]) for k, m in out.items() if not m["gone"]}


def test_logs_fold_as_event_by_event(spark):
    rng = random.Random(11)
    log = []
    for conv in range(150):
        for seq in range(rng.randrange(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            log.append((conv, seq, rng.randrange(5), kind, rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", "</s>", None])))
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.fold(spark.createDataFrame(log, LOG).repartition(5)).collect()}
    assert got == folded(log)


def test_a_later_message_starts_anew_after_a_regeneration(spark):
    log = [(1, 1, 1, "message", "user", "q"), (1, 2, 2, "message", "assistant", "x"), (1, 3, 3, "message", "user", "old"), (1, 4, 2, "regenerate", None, None), (1, 5, 2, "delta", None, "y"), (1, 6, 3, "delta", "user", "new")]
    got = chat.fold(spark.createDataFrame(log, LOG)).orderBy("message").collect()
    assert [(r["message"], r["text"]) for r in got] == [(1, "q"), (2, "y"), (3, "new")]


def ordinal_loss(rows, grades, top, weights, thresholds, decay):
    """The weighted negative log-likelihood that quality.fit goes down, a row at a time."""
    sizes = [list(grades).count(k) for k in range(top + 1)]
    total = decay / 2 * sum(w * w for w in weights.values())
    for row, grade in zip(rows, grades, strict=True):
        score = sum(weights[int(b)] for b in row)
        above = [1.0, *(1 / (1 + math.exp(t - score)) for t in thresholds), 0.0]
        total -= math.log(above[grade] - above[grade + 1]) / sizes[grade] / (top + 1)
    return total


def test_fit_ends_where_the_likelihood_is_flat():
    rng = random.Random(12)
    grades = np.array([i % 3 for i in range(90)])
    rows = [np.array(sorted({int(g) if rng.random() < 0.6 else rng.randrange(6), 6 + rng.randrange(3)})) for g in grades]
    decay = 0.02
    model = quality.fit(rows, grades, 2, steps=4000, decay=decay)
    weights = dict(zip(model.buckets.tolist(), model.weights.astype(float).tolist(), strict=True))
    at = ordinal_loss(rows, grades, 2, weights, model.thresholds, decay)
    for b in weights:
        for step in (-0.05, 0.05):
            assert ordinal_loss(rows, grades, 2, weights | {b: weights[b] + step}, model.thresholds, decay) > at - 1e-6
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = [t + step * (i == k) for i, t in enumerate(model.thresholds)]
            assert ordinal_loss(rows, grades, 2, weights, moved, decay) > at - 1e-6


def test_tails_are_sums_of_chances():
    model = quality.OrdinalModel(np.zeros(0, int), np.zeros(0, np.float32), np.array([-1.0, 0.5, 2.0]))
    p = model.above(np.array([-3.0, 0.2, 5.0]))
    for row, score in zip(p, (-3.0, 0.2, 5.0), strict=True):
        assert np.allclose(row, [1 / (1 + math.exp(t - score)) for t in model.thresholds]) and (np.diff(row) < 0).all()


def test_trigrams_by_counting():
    texts = ["", "a", "ab", "Abc", "aBCabc", "é ü", "x" * 700 + "Y"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    got = langid.trigrams(np.frombuffer(b"".join(data), np.uint8), offsets, 256)
    for row, b in zip(got, data, strict=True):
        b, want = bytes(x + 32 if 65 <= x <= 90 else x for x in b) + b"\0\0", np.zeros(256, int)
        for i in range(len(b) - 2):
            want[(int.from_bytes(b[i : i + 3], "little") * 2654435761 % 2**32) >> 24] += 1
        assert (row == want).all()


def test_codes_are_decoded_by_the_least_loss():
    rng = np.random.default_rng(13)
    code = langid.codewords(5)
    model = langid.LanguageModel(list("abcde"), code, rng.normal(size=(64, code.shape[1])).astype("f4") * 8, rng.normal(size=code.shape[1]).astype("f4"), rng.random(code.shape[1]).astype("f4"))
    counts = rng.integers(0, 9, (40, 64)) * (rng.random((40, 64)) < 0.3)
    best, chance, lead = model.predict(counts)
    for i, row in enumerate(counts):
        share = row / max(row.sum(), 1)
        margin = [sum(share[f] * float(model.weights[f, j]) for f in range(64)) + float(model.bias[j]) for j in range(code.shape[1])]
        loss = [sum(float(model.trust[j]) * math.log1p(math.exp(-m * word[j])) for j, m in enumerate(margin)) for word in code.tolist()]
        odds = sorted((math.exp(min(loss) - x) for x in loss), reverse=True)
        assert best[i] == int(np.argmin(loss))
        assert math.isclose(chance[i], 1 / sum(odds), abs_tol=1e-4) and math.isclose(lead[i], (odds[0] - odds[1]) / sum(odds), abs_tol=1e-4)
