import hashlib
import math
import random
import re

from quillframe.llm import secrets_scan as S
from tests.llm.conftest import words

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(t):
    t = t or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    more = set()
    for pattern, bits in S.CLASSES.values():
        for m in re.finditer(pattern, t):
            x = m[0]
            if not re.search("[0-9]", x) or not re.search("[A-Za-z]", x) or re.search(S.ALLOWED, x):
                continue
            limit = math.floor((math.log2(S.WINDOW) - bits) * S.WINDOW * (1 << 24))
            hits = [i for i in range(len(x) - S.WINDOW + 1) if sum(S.N_LOG_N[x[i : i + S.WINDOW].count(c)] for c in set(x[i : i + S.WINDOW])) <= limit]
            if hits:
                more.add((m.start() + hits[0], 3, m.start() + hits[-1] + S.WINDOW))
    more = [z for z in more if not any(y[0] <= z[0] and z[2] <= y[2] for y in base)]
    join = lambda z: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(z))
    return *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(join(base).encode()).hexdigest(), join([*base, *more])


def test_against_brute_force(spark):
    r = random.Random(3)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12", "abc", "0123456789abcdef", "deadbeef", "é", "😀", "\n", "xY9/", "+Qz7", "Zk3mW8pL", "foo.bar", "example", "-", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)] + [None, "", "aB3" * 2000, "f" * 3000]
    texts += ["password=secret1 " * 700 + "AKIA" + "Q" * 16, "".join(r.choice("abcdefghijkmnpqrstuvwxyz23456789") for _ in range(4500)), "a1" * 3000 + "Zx8Qw2Lp9Vn4Rt7Yb1Mc6K" + "b2" * 3000]
    texts += ["secret: token = abcdefgh", "123e4567-e89b-12d3-a456-426614174000 x", "k=Zx8Qw2Lp9Vn4Rt7Yb1Mc6K", "Zx8Qw2Lp9Vn4Rt7Yb1Mc6Kd3aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    got = {x.doc_id: tuple(x)[1:] for x in S.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
    assert sum("entropy" in v[-1] for v in got.values()) > 20


def test_planted_secrets_are_found_and_prose_is_not(spark):
    """Random keys that no base pattern names, each in prose: at least nine of ten are found, and nothing in the prose alone."""
    r = random.Random(5)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789"]
    rows, planted = [], {}
    for i in range(300):
        key = "".join(r.choice(alphabets[i % 3]) for _ in range(r.choice([24, 32, 40, 64])))
        before, after = words(i, r.randint(0, 30)), words(1000 + i, 20)
        rows += [(2 * i, f"{before} {key} {after}"), (2 * i + 1, f"{before} {after} some-long-hyphenated-word-2024 https://example.org/a/b")]
        planted[2 * i] = (len(before) + 1, len(before) + 1 + len(key))
    found = {x.doc_id: x.spans for x in S.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = [0, 0, 0]
    for i, (a, b) in planted.items():
        spans = [tuple(map(int, x.split(":")[1:])) for x in found[i].split(",") if x.startswith("entropy")]
        hits[i // 2 % 3] += any(a <= s and e <= b and (e - s) * 2 >= b - a for s, e in spans)
    assert min(hits) >= 90, hits
    assert not any("entropy" in s for i, s in found.items() if i % 2)


def test_odd_rows(odd, odd_rows, none):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in S.found(odd).collect()), key=key) == sorted(((r[0], *brute(r[1])) for r in odd_rows), key=key)
    assert S.found(none).count() == 0


def test_plan_is_native(odd):
    plan = S.found(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
