"""Plain versions of what the queries return, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile("[^\x20\x09-\x0d]+")
BLANKS = " \t\n\x0b\x0c\r"


def base_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def line_dedup(docs, min_docs=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(lower)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and i < max(holders[key(x)]))]
        out[i] = len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def suffix_dedup(docs, length=50):
    first = {}
    for i, text in sorted(docs):
        body = (text or "").encode()
        for k in range(len(body) - length + 1):
            first.setdefault(body[k : k + length], i)
    out = {}
    for i, text in docs:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for k in range(len(body) - length + 1):
            if first[body[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def bag(text, width=5):
    words = WORDS.findall(text or "")
    if words and len(words) < width:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(sum((a | b).values()), 1)


def near_groups(docs, least=0.8):
    """doc_id to the least doc_id of its connected component, by comparing all pairs that share a shingle."""
    bags = {i: bag(t) for i, t in docs}
    having = defaultdict(list)
    for i, b in bags.items():
        for s in b:
            having[s].append(i)
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for ids in having.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if similarity(bags[a], bags[b]) >= least:
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: find(i) for i in bags}


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match("[^?#]*", rest[len(host) :])[0]


def url_rule(host, path, rules):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)
