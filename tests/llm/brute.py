"""Slow, plain versions of the operators' contracts."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    w = WORD.findall(lowered(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def ngram_components(rows, n, percent):
    """rows: (doc_id, text). {(doc_id, size, component)} as a sorted list."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    classes = {}
    for i, s in sets:
        if s:
            classes.setdefault(s, []).append(i)
    keys = list(classes)
    top = list(range(len(keys)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    where = {}
    for k, s in enumerate(keys):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(keys):
        both = Counter(j for x in s for j in where[x] if j < k)
        for j, m in both.items():
            if 100 * m >= percent * (len(s) + len(keys[j]) - m):
                top[find(k)] = find(j)
    least = {}
    for k, s in enumerate(keys):
        ids = [i for i in classes[s] if i is not None]
        if ids:
            r = find(k)
            least[r] = min(least.get(r, min(ids)), min(ids))
    at = {s: k for k, s in enumerate(keys)}
    return sorted(((i, len(s), least.get(find(at[s])) if s else i) for i, s in sets), key=repr)


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    three = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if three[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def pii_row(text):
    spans = pii_spans(text)
    names = list(PII)
    written = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    return tuple(sum(k == n for _, k, _ in spans) for n in range(4)) + (hashlib.sha256(written.encode()).hexdigest(),)


def crc(text):
    return zlib.crc32((text or "").encode())
