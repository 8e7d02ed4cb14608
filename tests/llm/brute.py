"""Slow, plain versions of the operators, for small tables."""

import bisect
import collections
import re

import numpy as np

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text):
    w = SPACE.findall(text.translate(UPPER))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def near_classes(rows, similarity=0.8):
    """doc_id -> least doc_id of its class, for (doc_id, text)."""
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(k, t, bag(t)) for k, t in rows if t is not None]
    for i, (a, ta, x) in enumerate(bags):
        for b, tb, y in bags[:i]:
            both, total = sum((x & y).values()), sum((x | y).values())
            if ta == tb or (total and both >= similarity * total):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in root}


def line_templates(rows, leading=2, constant=0.6, shares=(0.2, 0.02)):
    """line -> its templates (tuples of tokens, None for a variable field), over rows (document, text)."""
    docs, out = collections.defaultdict(set), {}
    for k, text in rows:
        for line in (text or "").split("\n"):
            tokens = tuple(SPACE.findall(line))
            if tokens:
                docs[tokens].add(k)
    free = lambda tokens: tuple(None if re.search("[0-9]", t) else t for t in tokens)
    enough = lambda tokens: sum(t is not None for t in tokens) >= constant * len(tokens)
    leaves = collections.defaultdict(list)
    for tokens in docs:
        out[tokens] = {("exact", tokens)}
        masked = free(tokens)
        if enough(masked):
            if masked != tokens:
                out[tokens].add(("leaf", masked))
            if len(tokens) > leading + 1:
                leaves[len(tokens), masked[:leading]].append(tokens)
    for members in leaves.values():
        at = collections.defaultdict(list)
        for tokens in members:
            for i, t in enumerate(free(tokens)):
                at[i, t].append(tokens)
        for tokens in members:
            for share in shares:
                fixed = lambda i, t: i < leading or (len(at[i, t]) >= share * len(members) and len(set().union(*(docs[m] for m in at[i, t]))) > 1)
                general = tuple(t if t is not None and fixed(i, t) else None for i, t in enumerate(free(tokens)))
                if enough(general) and any(t is not None for t in general[leading:]):
                    out[tokens].add(("leaf", general))
    return out


def line_dedup(rows):
    """doc_id -> kept text."""
    own, docs = line_templates(rows), collections.defaultdict(set)
    for k, text in rows:
        for line in (text or "").split("\n"):
            for t in own.get(tuple(SPACE.findall(line)), ()):
                docs[t].add(k)
    drop = lambda k, line: any(len(docs[t]) > 1 and k > min(docs[t]) for t in own.get(tuple(SPACE.findall(line)), ()))
    return {k: text if text is None else "\n".join(x for x in text.split("\n") if not drop(k, x)) for k, text in rows}


def leaks(text, items, width=8):
    """(hit words, their spans in characters, item ids) of a document."""
    found = [(m[0], m.span()) for m in ALNUM.finditer((text or "").translate(UPPER))]
    words, hit, ids = [w for w, _ in found], set(), set()
    for key, item in items:
        w = ALNUM.findall((item or "").translate(UPPER))
        n = min(width, len(w))
        for i in range(max(1, len(w) - width + 1)) if w else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    ids.add(str(key))
    return len(words), hit, [s for _, s in found], ids


def cut(text, hit, spans):
    out, at = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += text[at : spans[i][0]]
        at = spans[i][1]
    return out + text[at:]


def best_fit_bins(lengths, size):
    bins, room = 0, []
    for s in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, s)
        r = room.pop(i) if i < len(room) else size
        bins += r == size
        if r > s:
            bisect.insort(room, r - s)
    return bins


def ids(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
