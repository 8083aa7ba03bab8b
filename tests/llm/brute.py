"""Plain versions of the operators' contracts, a document at a time."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def token_ids(texts, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """{kind: spans} as the base patterns are worded."""
    text = text or ""
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out["card"] = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def personal_text(found):
    kinds = list(found)
    spans = sorted((a, kinds.index(k), b, k) for k in kinds for a, b in found[k])
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def shingles(text):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_components(texts):
    """texts: {id: text}. Every linked pair by comparing all, then components by the smallest id."""
    sets = {i: shingles(t) for i, t in texts.items()}
    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    shared = {}
    for places in at.values():
        for p, a in enumerate(places):
            for b in places[p + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def in_order(x, y):
    """Most words of x and y that match in order."""
    row = [0] * (len(y) + 1)
    if x == y:
        return len(x)
    for w in x:
        diagonal = 0
        for j, v in enumerate(y, 1):
            diagonal, row[j] = row[j], max(row[j], row[j - 1], diagonal + (v == w))
    return row[-1]


def exact_runs(words, n):
    """Of each document the places of words in a run of n that a document of a smaller identifier has."""
    first, out = {}, {}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), i) != i:
                out.setdefault(i, set()).update(range(k, k + n))
    return out
