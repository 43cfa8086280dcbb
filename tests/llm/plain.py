"""Plain Python versions of operators, that tests hold the Spark ones against."""

import re
import zlib

import numpy as np

LOWER = {i: i + 32 for i in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def language(text, model):
    """(language, cosine, rejected) from one n-gram after the other."""
    letters = [(low if len(low := c.lower()) == 1 else c) if c.isalpha() else " " for c in text or ""]
    if not any(c != " " for c in letters):
        return "und", 0.0, True
    s = re.sub(" +", " ", f" {''.join(letters)} ")
    counts, wrap, c = {}, (1 << 32) - 1, [ord(x) for x in s]
    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) & wrap for a, b in zip(c, c[1:])]
    three = [(t * 0xC2B2AE3D + b * 0x27D4EB2F) & wrap for t, b in zip(two, c[2:])]
    for h in [(a * 0x165667B1) & wrap for a in c] + two + three:
        counts[h >> 18] = counts.get(h >> 18, 0) + 1
    v = np.zeros(len(model.idf))
    for k, n in counts.items():
        v[k] = np.log1p(n) * model.idf[k]
    near = model.centroids @ (v / np.linalg.norm(v))
    at = int(near.argmax())
    sure = min(1.0, sum(counts.values()) / (3 * 256))
    return model.languages[model.owner[at]], float(near[at]), near[at] < sure * model.least[model.owner[at]]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_dedup(rows):
    """Of (id, text) rows, the one with the smallest id of each group that 5-word Jaccard similarities of 0.8 or more connect."""
    texts = list(dict.fromkeys(t for _, t in rows))
    s, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    at, groups = {t: i for i, t in enumerate(texts)}, {}
    for row in rows:
        groups.setdefault(top(at[row[1]]), []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def windows(items):
    """The 13-word windows of (item_id, text) items, with the items that have them."""
    out = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w else ():
            out.setdefault(tuple(w[k : k + n]), set()).add(i)
    return out


def contaminated(text, benchmark):
    w, hit = ALNUM.findall((text or "").translate(LOWER)), set()
    for n in {len(x) for x in benchmark}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in benchmark:
                hit.update(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def targets(sizes):
    """Of each source its target: weights 5, 2, 1 in order of name, null last; at most 3 times its size, the excess shared again."""
    names = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, total, out = set(names), float(sum(sizes.values())), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 3 * sizes[s]]
        out |= {s: 3.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in left}
        left = left - set(over) if over else set()
    return out


def size(text):
    return len(PLAIN.findall(text or ""))


def token_rows(rows, encoder):
    """(doc_id, start, n_tokens, ids_crc32) of (id, text) rows in order of id, null first."""
    start, out = 0, []
    for doc_id, ids in sorted(((i, encoder.library([t or ""])[0]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.append(np.frombuffer(ids, "<u2"), 0).astype("<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out
