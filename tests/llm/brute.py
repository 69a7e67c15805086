"""Plain versions of the corpus operators' contracts, for small inputs."""
import hashlib
import re
from collections import Counter, defaultdict

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def line_dedup(docs):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3
                or max(holders[key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def sentence_pieces(docs, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = {}
    for doc, text in docs:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out[doc] = (len(ids), sha(raw), sha(sp.decode(ids)))
    return out


def quality_base(docs):
    out = {}
    for doc, text in docs:
        text = text or ""
        words = BLANK_WORDS.findall(text)
        seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        repeat = set()
        for i in range(len(words) - 2):
            if seen[tuple(words[i:i + 3])] > 1:
                repeat.update((i, i + 1, i + 2))
        lines = [x for x in text.split("\n") if BLANK_WORDS.search(x)]
        n = len(words)
        out[doc] = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                    len(lines) - len(set(lines)), len(repeat),
                    n < 50 or 100 * len(repeat) > 50 * n)
    return out


def leaks(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM_WORDS.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins[tuple(w[i:i + window])].add(item)
    sizes = {len(x) for x in wins}
    out = {}
    for doc, text in docs:
        w = ALNUM_WORDS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i:i + n])]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def near_classes(docs, size=4, percent=85):
    sets = {}
    for doc, text in docs:
        w = BLANK_WORDS.findall((text or "").translate(LOWER))
        sets[doc] = ({tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
                     or ({tuple(w)} if w else set()))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            by[x].append(doc)
    pairs = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                pairs[a, b] += 1
    for (a, b), both in pairs.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeated_bytes(docs, size=200):
    raw = {d: (t or "").encode() for d, t in docs}
    seen = Counter(b[i:i + size] for b in raw.values() for i in range(len(b) - size + 1))
    out = {}
    for doc, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = b"\x01" * size
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans,
                    sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def repeated_words(docs, size=20):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        w = BLANK_WORDS.findall(text or "")
        gone = set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            if key in seen:
                gone.update(range(i, i + size))
            seen.add(key)
        out[doc] = (len(w), len(gone), sha(" ".join(
            x for i, x in enumerate(w) if i not in gone)))
    return out
