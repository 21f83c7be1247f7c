"""Rewrites of long sentences against the rule written out by hand; contexts of findings by site."""

import random
import re

from pagelattice.operators import documents, findings
from pagelattice.plans import dims

WORDS = ["alpha", "beta", "and", "gamma,", "delta", "which", "Epsilon;", "zeta", "eta", "theta", "x-ray", "1st", "so", "iota:", "menu"]


def noise(s):
    w = re.findall(r"\b[a-zA-Z]+\b", s.lower())
    return any(p in s.lower() for p in dims.MENU_PHRASES) or s.count("\n") >= 2 or not w or (len(w) >= 25 and len(set(w)) > 0.85 * len(w))


def rewrite(s):
    t = s.split()
    if len(t) <= 22:
        return s
    mid = len(t) // 2
    at = [i for i, x in enumerate(t) if x.endswith((",", ";", ":")) or x.strip(",;:").lower() in documents.CONJUNCTIONS]
    i = min(at, key=lambda i: abs(i - mid)) if at else mid
    i = mid if i < 8 or i > len(t) - 8 else i
    a, b = t[:i], t[i:]
    b = b[1:] if b[0].strip(",;:").lower() in documents.CONJUNCTIONS else b
    up = lambda x: x[:1].upper() + x[1:]
    return f"{up(' '.join(a).rstrip(',;:.'))}. {up(' '.join(b).lstrip(',;: '))}."


def test_rewrites(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        text = " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 60))) + rng.choice(".!?") for _ in range(8))
        rows.append((i, text + (" Read more " + "word " * 70 + "." if i % 4 == 0 else "") + (" " + " ".join(f"u{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) + "." if i % 3 == 0 else "")))
    rows += [(100, None), (101, ""), (102, "short. " * 3)]
    want = set()
    for i, text in rows:
        s = [x.strip() for x in re.split(r"(?<=[.!?])\s+", text or "") if x.strip()]
        n = {k: sum(bool(re.fullmatch("[a-zA-Z]+", w)) for w in re.findall(r"\w+", x)) for k, x in enumerate(s)}
        top = sorted((k for k in n if n[k] > 25), key=lambda k: (-n[k], k))[:5]
        want |= {(i, r + 1, rewrite(x)) for r, x in enumerate([s[k] for k in top if not noise(s[k])][:3])}
    got = {tuple(r) for r in documents.sentence_rewrites(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(got) > 60


def test_contexts_by_site(spark):
    f = spark.createDataFrame([("a", 1, "s", "No code examples detected", "Critical"), ("b", 2, "s", "No code examples detected.", "Warning")], "site string, seq int, source string, finding string, severity string")
    c = spark.createDataFrame([("a", 3, 1, True, 5), ("a", 0, 1, True, 5), ("b", 0, 1, True, 5)], "site string, code_block_count int, h1_count int, has_install_section boolean, heading_count int")
    got = findings.verified(f, c).collect()
    assert [(r.severity, r.merged) for r in got] == [("Warning", 1)]
    assert findings.verified(f.drop("site"), c).count() == 0
