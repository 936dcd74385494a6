"""Slow and plain versions of operators, for tests."""

def slow_sets(text, n=5):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def slow_kept(texts, similarity=0.8):
    """doc_id -> text: the smallest id of each group, all pairs compared."""
    sets, top = {d: slow_sets(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                ra, rb = find(a), find(b)
                top[max(ra, rb)] = min(ra, rb)
    return {d for d in ids if find(d) == d}


def within(a, b, t):
    """Whether two texts are within t edits, by the plain table cut to a band."""
    if abs(len(a) - len(b)) > t:
        return False
    row = {j: j for j in range(t + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - t), min(len(b), i + t) + 1):
            v = row.get(j, 99) + 1
            if j:
                v = min(v, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (a[i - 1] != b[j - 1]))
            new[j] = v
        row = new
        if min(row.values()) > t:
            return False
    return row.get(len(b), 99) <= t


def lines_kept(docs, t=2, least=20):
    """doc_id -> text without lines that have an equal or near one before; documents left without words are missing."""
    occ = sorted((d, k, s.strip(" ")) for d, text in docs for k, s in enumerate((text or "").split("\n")) if len(s.strip(" ")) >= least)
    texts = sorted({s for *_, s in occ}, key=len)
    top = {s: s for s in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if len(b) - len(a) > t:
                break
            if within(a, b, t):
                top[find(a)] = find(b)
    seen, gone = set(), set()
    for d, k, s in occ:
        r = find(s)
        if r in seen:
            gone.add((d, k))
        seen.add(r)
    out = {}
    for d, text in docs:
        parts = (text or "").split("\n")
        left = "\n".join(x for k, x in enumerate(parts) if (d, k) not in gone)
        if left.split() or not any((d, k) in gone for k in range(len(parts))):
            out[d] = left if text is not None else None
    return out
