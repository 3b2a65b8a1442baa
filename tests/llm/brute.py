"""The contracts in plain Python, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def least_id(ids, roots):
    best = {}
    for i, r in zip(ids, roots):
        if i is not None:
            best[r] = min(i, best.get(r, i))
    return [best.get(r) for r in roots]


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(ids, texts):
    fps = [fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    return [(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, least_id(ids, groups(len(fps), pairs)))]


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def bpe(coder, text):
    ids = coder.encode(text or "", add_special_tokens=False).ids
    packed = np.array(ids, "<u4").tobytes()
    return len(ids), sha(packed), sha(coder.decode(ids, skip_special_tokens=False).encode())


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 10 == 0


def katz(ids, texts, order, good_turing):
    tokens = [[*WORD.findall(lower(t)), None] for t in texts]
    counts = [Counter() for _ in range(order + 1)]
    for i, t in zip(ids, tokens):
        padded = ["<s>"] * (order - 1) + t
        for at in range(order - 1, len(padded) if not held(i) else 0):
            for k in range(1, order + 1):
                counts[k][tuple(padded[at - k + 1 : at + 1])] += 1
    contexts = [None] + [Counter() for _ in range(order)]
    after = [None] + [defaultdict(list) for _ in range(order)]
    discounts = [None]
    for k in range(1, order + 1):
        number = Counter(counts[k].values())
        discounts.append(good_turing([number[r] for r in range(1, 7)]))
        for g, c in counts[k].items():
            contexts[k][g[:-1]] += c
            after[k][g[:-1]].append(g[-1])
    total, distinct = sum(counts[1].values()), len(counts[1])

    def kept(k, c):
        return discounts[k][c] * c if c <= 5 else c - 1e-3

    def p(k, h, w):
        c = counts[k].get((*h, w), 0)
        if c:
            return kept(k, c) / contexts[k][h]
        if not contexts[k].get(h):
            return p(k - 1, h[1:], w) if k > 1 else 1.0
        left = 1 - sum(kept(k, counts[k][(*h, x)]) for x in after[k][h]) / contexts[k][h]
        if k == 1:
            return left
        return left / (1 - sum(p(k - 1, h[1:], x) for x in after[k][h])) * p(k - 1, h[1:], w)

    out = []
    for i, t in zip(ids, tokens):
        padded = ["<s>"] * (order - 1) + t
        score = sum(
            math.log10(p(order, tuple(padded[a - order + 1 : a]), padded[a])) for a in range(order - 1, len(padded))
        )
        base = sum(math.log10((counts[1].get((w,), 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        known = sum(counts[1].get((w,), 0) > 0 for w in t)
        out.append((i, held(i), len(t), known, total, base, score))
    return out, p, after, distinct


def alignment(ids, texts, byte_name="byte_bpe_50k.json", piece_name="piece_bpe_32k.model"):
    """Per text, token by token; the counts of pairs over all texts."""
    import sentencepiece

    from cartshift.llm.automaton import byte_names

    coder = tokenizer(byte_name)
    coder.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_name))
    letters = byte_names()

    def spelt(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    found = []
    for t in texts:
        a = coder.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        one, other = [bytes(letters[c] for c in coder.id_to_token(i)) for i in a], [spelt(i) for i in b]
        raw = (" " + t).encode() if t else b""
        if b"".join(one) != raw or b"".join(other) != raw:
            a, b, one, other = [], [], [], []
        ends_a, ends_b = ends(one), ends(other)
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
        shown, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            shown.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        found.append((len(a), len(b), shown, links))
    counts = Counter(x for f in found for x in f[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (i, na, nb, len(shown), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         sha(";".join(shown).encode()) if na else "")
        for i, (na, nb, shown, links) in zip(ids, found)
    ]
