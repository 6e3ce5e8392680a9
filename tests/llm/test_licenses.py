"""License scans against brute force."""

import re

import numpy as np

from voxelith.llm import licenses


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def shingles(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def brute(cases, templates):
    """Templates of which 3/4 lies in some stretch as long as the widened windows at most."""
    out = set()
    for i, t in cases:
        s = shingles(words(t))
        for name, body in templates.items():
            own = shingles(words(body))
            if own:
                best = max((len(set(own) & set(s[k : k + len(own)])) / len(set(own)) for k in range(len(s))), default=0)
                if best >= 0.75:
                    out.add((i, name))
    return out


def test_scan(spark):
    rng = np.random.default_rng(1)
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit".split()
    names = list(licenses.TEMPLATES)
    cases = [(0, None), (1, ""), (2, "one two"), (None, licenses.TEMPLATES["MIT"]), (3, "Released   under the\nMIT License"), (4, "Released under the NIT License")]
    for k in range(120):
        body = words(licenses.TEMPLATES[names[k % len(names)]])
        if rng.random() < 0.4 and len(body) > 25:
            body[int(rng.integers(len(body)))] = "changed"
        a, b = (rng.choice(filler, int(rng.integers(0, 60))).tolist() for _ in range(2))
        cases.append((k + 10, " ".join(a + body + b)))
    df = spark.createDataFrame([(*c, "x") for c in cases], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()}
    assert got == brute(cases, licenses.TEMPLATES)
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, {"short": "too few words"}).count() == 0


def test_regions_are_counted(spark):
    t = licenses.TEMPLATES["GPL-3.0 notice"]
    gap = " word" * 200
    df = spark.createDataFrame([(1, t + gap + t + gap), (1, t)], "doc_id long, text string")
    assert sorted(r["regions"] for r in licenses.scan(df).filter("license = 'GPL-3.0 notice'").collect()) == [1, 2]
