"""Plain versions of what the operators compute, and documents of the awkward kinds."""

import random
import re
from collections import Counter

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashing and surplus columns that no operator may trip over.
CLASHES = "key long, fp long, component_id string, Text string, n_words string, kept string, shard string, bin string, `_key` string, base string"

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    counts = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        counts.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def components(nodes, linked):
    """node -> least node of its component, by all pairs."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def prose(seed, n):
    r = random.Random(seed)
    lines = []
    while n > 0:
        k = min(n, r.randint(6, 14))
        lines.append(" ".join("".join(r.choice(["an", "er", "tion", "the", "in", "re", "os", "le", "ung"]) for _ in range(r.randint(1, 3))) for _ in range(k)).capitalize() + ".")
        n -= k
    return "\n".join(lines)


def awkward():
    """Null, empty and blank texts, null ids and columns, ties, repeated rows, a very long text and one very long word."""
    long = prose(5, 30_000)
    rows = [
        (1, None, "en", "s0", None), (2, "", None, "s0", 0), (3, " \t\n\x0b\x0c\r", "en", None, 6), (4, prose(1, 80), "en", "s0", 1), (5, prose(1, 80), "en", "s1", 1),
        (5, prose(1, 80), "en", "s1", 1), (5, prose(1, 80), "en", "s1", 1), (None, prose(2, 60), "fr", "s1", 1), (None, None, None, None, None), (6, long, "fr", "s0", len(long)),
        (7, "x" * 50_000, "de", "s0", 50_000), (8, "naïve café 漢字 😀 " * 20, "fr", "s0", 10), (9, "one", "en", "s0", 3), (10, "<|endoftext|> a <|endoftext|>", "en", "s0", 3),
        (11, "mail a.b@c.de call +1 (743) 555-3824 at 10.0.0.1 or 4111 1111 1111 1111", "en", "s0", 3), (12, "123 456", "en", "s0", 7),
    ]
    return rows


def frame(spark, rows, clashes=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        more = [c.strip().split()[0].strip("`") for c in CLASHES.split(",")]
        extra = spark.createDataFrame([(*r, *([None] * len(more))) for r in rows], f"{SCHEMA}, {CLASHES}")
        return extra
    return df
