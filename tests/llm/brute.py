"""Brute-force versions of the operators' contracts, in plain Python over small tables."""

import hashlib
import re
import struct
import zlib

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = " \t\n\x0b\x0c\r"


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    words = [w.decode("utf-8", "surrogatepass") for w in WORD.findall(lower(text or "").encode("utf-8", "surrogatepass"))]
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def near_docs(docs, width, percent):
    """docs: {id: text} -> {id: (n_shingles, component)}."""
    sets = {d: shingles(t, width) for d, t in docs.items()}
    ids = [d for d in docs if sets[d]]
    post = {}
    for d in ids:
        for s in sets[d]:
            post.setdefault(s, []).append(d)
    links = set()
    for d in ids:
        common = {}
        for s in sets[d]:
            for e in post[s]:
                if e > d:
                    common[e] = common.get(e, 0) + 1
        links |= {(d, e) for e, n in common.items()
                  if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n)}
    comp = components(list(docs), links)
    return {d: (len(sets[d]), comp[d]) for d in docs}


def near_vectors(rows, cosine):
    """rows: [(id, vector, label)] -> {id: (n_links, component)}."""
    good = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None for x in v):
            continue
        a = np.array(v, float)
        if len(a) and np.isfinite(a).all() and a.any():
            good[i] = (a / np.linalg.norm(a), label)
    ids = sorted(good)
    links = [(i, j) for x, i in enumerate(ids) for j in ids[x + 1:]
             if good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= cosine]
    n = {i: 0 for i, _, _ in rows}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    comp = components([i for i, _, _ in rows], links)
    return {i: (n[i], comp[i]) for i, _, _ in rows}


def repeated_bytes(docs, width=100):
    """docs: {id: text} -> {id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    first, gone = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        cover = bytearray(len(raw) + 1)
        mark = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - width + 1):
            w = raw[s:s + width]
            if w in first:
                mark[s] += 1
                mark[s + width] -= 1
            else:
                first.add(w)
        cover = np.cumsum(mark)[:len(raw)] > 0
        rest = bytes(np.frombuffer(raw, np.uint8)[~cover])
        spans = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(raw) else 0
        gone[d] = (len(raw), int(cover.sum()), spans, hashlib.sha256(rest).hexdigest())
    return gone


def edited(docs):
    """docs: {id: text} -> {id: edited text}, by descending id."""
    order = sorted(docs, reverse=True)
    out = {}
    for k, d in enumerate(order):
        t, n = docs[d] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        out[d] = t[:len(t) - half] + n[:half]
    return out


def paragraphs(text):
    """Pieces between sentence marks; those of more than 160 characters end after words (characters) that xxhash64 picks."""
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    ends = lambda unit, one_in: "\x01" if signed(xxhash.xxh64_intdigest(unit.encode(), seed=42)) % one_in == 0 else ""
    out = set()
    for p in re.split(r"[.!?\n。．！？；｡।]+", text or ""):
        if len(p) > 160:
            words = ["".join(c + ends(c, 24) for c in w) + ends(w, 12) if len(w) > 64 else w + ends(w, 12)
                     for w in re.split(r"[ \t\n\x0b\f\r]+", p)]
            out.update(x.strip(" ") for x in " ".join(words).split("\x01"))
        else:
            out.add(p.strip(" "))
    return out - {""}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def _mix(number, digest):
    seed = xxhash.xxh64_intdigest(struct.pack("<i", number), seed=42)
    return xxhash.xxh64_intdigest(struct.pack("<Q", digest), seed=seed)


def alike_by_prints(a, b):
    """Likeness read off two printed fingerprints alone: fold, subtract, peel; None where they cannot settle it."""
    def read(print_):
        head, _, rest = print_.partition("|")
        cells = [tuple(int(x, 16) for x in c.split(".")) for c in rest.split(":")] if rest else []
        return int(head, 16) if head else 4, cells

    (wa, ca), (wb, cb) = read(a), read(b)
    w, diff = min(wa, wb), {}
    for sign, cells in ((1, ca), (-1, cb)):
        for cell, n, x, c in cells:
            at = (cell // 3 & (w - 1), cell % 3)
            m, y, d = diff.get(at, (0, 0, 0))
            diff[at] = (m + sign * n, y ^ x, d ^ c)
    total = sum(n for cell, n, _, _ in ca if cell % 3 == 0)
    only = {1: 0, -1: 0}
    while pure := next(((n, x) for n, x, c in diff.values() if abs(n) == 1 and _mix(9973, x) == c), None):
        n, x = pure
        only[n] += 1
        for row in range(3):
            at = (_mix(row, x) & (w - 1), row)
            m, y, d = diff[at]
            diff[at] = (m - n, y ^ x, d ^ _mix(9973, x))
    if any(v != (0, 0, 0) for v in diff.values()):
        return None
    union = total + only[-1]
    return 1.0 if not union else (total - only[1]) / union


def tokens(texts, end_id):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end_id], "<u4") for x in texts]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
