"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def word_windows(docs, length=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            gram = tuple(w[a:a + length])
            if gram in seen:
                gone[a:a + length] = [True] * length
            seen.add(gram)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def byte_strings(docs, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    first, out = {}, {}
    for i, text in sorted(docs.items()):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first.setdefault(b[a:a + length], i) < i:
                gone[a:a + length] = b"\1" * length
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shingles(text, width):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_groups(docs, width, percent=80):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                common[j] += 1
            holders[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(docs, items, n=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256)}"""
    def cut(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        size = min(n, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[a:a + size])].add(str(item))
    sizes, out = {len(w) for w in windows}, {}
    for i, text in docs.items():
        w = cut(text)
        hit, found = set(), set()
        for size in sizes:
            for a in range(len(w) - size + 1):
                if names := windows.get(tuple(w[a:a + size])):
                    hit.update(range(a, a + size))
                    found |= names
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))))
    return out


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    """[(start, kind, end)] of base matches."""
    def luhn(digits):
        return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(digits))) % 10 == 0
    out = []
    for k, (name, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 14 <= len(digits) <= 19 and luhn(
                    digits) or name == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def greedy_pieces(word, pieces):
    """Number of pieces that longest match cuts a word into; the word mark begins it, characters fall back to bytes."""
    start = {p[1:] for p in pieces if p.startswith("▁")} - {""}
    inner = {p for p in pieces if not p.startswith("▁")}
    at = n = 0
    known = start
    while at < len(word):
        size = next((s for s in range(len(word) - at, 0, -1) if word[at:at + s] in known), 0)
        if size:
            at, n = at + size, n + 1
        elif known is start:
            n += 1
        else:
            n += len(word[at].encode())
            at += 1
        known = inner
    return n
