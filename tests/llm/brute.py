"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SMALL = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(SMALL) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def line_dedup(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(SMALL)
    held = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    first = {k: min(v) for k, v in held.items() if len(v) > 1}
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def shingle_set(text):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    sets = {i: shingle_set(text) for i, text in rows}
    near = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                near[a].add(b)
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(sets[i]), min(seen))
    return out


def substring_dedup(rows, window=50):
    first = {}
    for i, text in rows:
        w = words(text)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, text in rows:
        w, gone = words(text), set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def contamination(rows, items):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(SMALL))
    owners = defaultdict(set)
    for name, text in items:
        w = split(text)
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            owners[tuple(w[j : j + size])].add(str(name))
    sizes = {len(k) for k in owners}
    out = {}
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if names := owners.get(tuple(w[j : j + size])):
                    hit |= set(range(j, j + size))
                    found |= names
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def targets(rows):
    """{source: (size, target)} of (source, size) rows, by sharing in rounds."""
    size = Counter()
    for source, n in rows:
        size[source] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        free -= set(over)
        left = sum(size.values()) - sum(target.values())
    return {s: (size[s], target[s]) for s in names}


def quality(text):
    w, text = words(text), text or ""
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


def rebuilt(rows):
    """{conv_id: [(role, text)]} of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = sha(f"{len(role.encode())}:{role}{text}")[:32]
            own[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return [
        (
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
            sha(",".join(map(str, sorted(ends[k])))),
        )
        for k, m in members.items()
    ]


def manifest(rows, arity=8):
    """{(doc_id, leaf): (subroot, root, proof, folded_root)} of rows (doc_id, source, lang, n_chars, text)."""
    h = lambda *parts: sha("".join(parts))
    leaf = lambda r: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(*last[i : i + arity]) for i in range(0, len(last), arity)])
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            start = i // arity * arity
            yield level[start:i], level[i + 1 : start + arity]
            i //= arity

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        groups[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: tree([leaf(r) for r in groups[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            path = [*siblings(trees[x], i), *siblings(top, k)]
            claimed = r[4]
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and claimed:
                claimed = claimed.translate(SMALL)
            folded = leaf((*r[:4], claimed))
            for left, right in path:
                folded = h(*left, folded, *right)
            proof = h(*[y for left, right in path for y in left + right])
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def personal_data(text):
    """{kind: [(start, end)]} of the fixed formats, by the patterns as they are written."""
    text = text or ""

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in rules.items()}
