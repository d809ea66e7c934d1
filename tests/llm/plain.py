"""Plain versions of the operators, one text after the other, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def classes(n, linked):
    """The class of each of n items, from pairs of linked items."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(a) for a in range(n)]


def simhash(docs):
    fps = []
    for _, text in docs:
        w = lower(text).encode().split()
        shingles = [b" ".join(w[a : a + 4]) for a in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    u = np.array(fps, np.uint64)
    pairs = [(a, int(b)) for a in range(len(u)) for b in np.flatnonzero(np.bitwise_count(u ^ u[a]) <= 4)]
    of = classes(len(docs), pairs)
    ids = collections.defaultdict(list)
    for a, c in enumerate(of):
        ids[c].append(docs[a][0])
    return [(docs[a][0], f"{fps[a]:016x}", least(ids[of[a]])) for a in range(len(docs))], of


def benchmark_hits(docs, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a : a + 10])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def warc(pages):
    groups = collections.defaultdict(list)
    for page, html in pages:
        groups[(html or "").encode()].append(page)
    out = []
    for page, html in pages:
        data = (html or "").encode()
        first = least(groups[data])
        again = len(data) >= 100 and first is not None and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_spans(text):
    kinds = (("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    found = [
        (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
        for rank, (kind, pattern, group, size) in enumerate(kinds)
        for m in pattern.finditer(text or "") if len(m.group(group)) >= size
    ]
    return [s for _, _, s in sorted(found)]


def add_one(docs):
    def tokens(text):
        return lower(text).encode().split() + [b""]

    c = collections.Counter(t for doc, text in docs if crc(doc) % 7 != 2 for t in tokens(text))
    total = sum(c.values())
    return [
        (doc, crc(doc) % 7 == 2, len(tokens(text)), sum(t in c for t in tokens(text)), total,
         sum(math.log10((c[t] + 1) / (total + len(c) + 1)) for t in tokens(text)))
        for doc, text in docs
    ]


def cosine_links(rows, limit=0.9):
    """Number of links and component of each ``(id, vector)``."""
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if o else None for o, (_, v) in zip(ok, rows)]
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(len(rows))
        if a != b and ok[a] and ok[b] and unit[a] @ unit[b] >= limit
    ]
    of = classes(len(rows), pairs)
    n = collections.Counter(a for a, _ in pairs)
    return [(rows[a][0], n[a], least(rows[b][0] for b in range(len(rows)) if of[b] == of[a])) for a in range(len(rows))]


def trie(rows, heads=6, shared=100):
    """Nodes of rebuilt conversations, from ``(conv_id, turn, role, text)``."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    own = {conv: [t[3:] for t in sorted(turns)] for conv, turns in by.items()}
    rebuilt = {}
    for conv in own:
        h = crc(conv) % heads
        rebuilt[conv] = own.get(conv - int(math.fmod(conv, shared)), [])[:h] + own[conv][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         sha(",".join(map(str, sorted(ends[p])))))
        for p, m in members.items()
    ]


def collocations(docs, least=30, top=2_000):
    """``(lang, rank, phrase, a, l, r, n, score)`` from ``(text, lang)``."""
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        explained = set()
        for p, a in often.items():
            for k in range(2, len(p)):
                explained |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= 80 * f[p[i : i + k]]}
        rows = []
        for p, a in often.items():
            if p not in explained:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def noisy_or(weights, bias, text):
    """The probability that a sentence offends, with a word's weight summed over its features."""
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        if sentence:
            z = bias
            for word in set(re.findall(r"[^\W\d_]+", sentence.lower())):
                z += weights.get("=" + word, 0.0) + sum(weights.get(word[:n], 0.0) for n in (3, 4, 5, 6) if len(word) >= n)
            none *= 1 - 1 / (1 + math.exp(-z))
    return 1 - none


def pitman_yor(training, texts, discounts, strength, sweeps, burn_in, seed=0):
    """log10 probabilities of ``texts`` (lists of words, an end each): customers leave and return one by one."""
    import collections
    import math
    import random

    d0, d1 = discounts
    draw = random.Random(seed).random
    known = {w for t in training for w in t}
    uniform = 1 / (len(known) + 1)
    parent = collections.defaultdict(list)  # dish: customers of each table
    rooms = collections.defaultdict(lambda: collections.defaultdict(list))

    def below(room, dish, d, base):
        c = sum(room[dish]) if dish in room else 0
        t = len(room[dish]) if dish in room else 0
        n, tables = sum(map(sum, room.values())), sum(map(len, room.values()))
        return (c - d * t + (strength + d * tables) * base) / (strength + n)

    def unigram(w):
        return below(parent, w, d0, uniform)

    def enter(room, dish, d, base):
        """Seat a customer; whether at a new table."""
        tables = sum(map(len, room.values()))
        weights = [x - d for x in room[dish]] + [(strength + d * tables) * base]
        at = draw() * sum(weights)
        for i, x in enumerate(weights):
            at -= x
            if at < 0 or i == len(weights) - 1:
                break
        if i == len(room[dish]):
            room[dish].append(1)
            return True
        room[dish][i] += 1
        return False

    def leave(room, dish):
        """A customer goes; whether its table goes too."""
        at, tables = draw() * sum(room[dish]), room[dish]
        for i, x in enumerate(tables):
            at -= x
            if at < 0 or i == len(tables) - 1:
                break
        tables[i] -= 1
        if not tables[i]:
            del tables[i]
            return True
        return False

    pairs = [(u, w) for t in training for u, w in zip(["", *t], t)]
    wanted = {(u, w) for t in texts for u, w in zip(["", *t], t)}
    total = dict.fromkeys(wanted, 0.0)
    for sweep in range(sweeps):
        for u, w in pairs:
            if sweep and leave(rooms[u], w):
                leave(parent, w)
            if enter(rooms[u], w, d1, unigram(w)):
                enter(parent, w, d0, uniform)
        if sweep >= burn_in:
            for u, w in wanted:
                total[u, w] += below(rooms[u], w, d1, unigram(w)) / (sweeps - burn_in)
    return [sum(math.log10(total[u, w]) for u, w in zip(["", *t], t)) for t in texts]
