"""Plain versions of the corpus operators' contracts, one document after another."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenizer() -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def bpe(rows):
    t, out = tokenizer(), []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def fingerprint(text: str | None, size: int = 3) -> int:
    words = WORD.findall((text or "").translate(UPPER))
    found = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    ones = [0] * 64
    for s in found:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(found))


def simhash(rows, tau: int = 3):
    prints = [(d, fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in prints})
    fp = np.array(distinct, np.uint64)
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= tau).tolist():
            a, b = find(f), find(distinct[i + 1 + j])
            root[max(a, b)] = min(a, b)
    least: dict = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in prints]


def quality(rows):
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        where = defaultdict(list)
        for i in range(len(words) - 7):
            where[tuple(words[i : i + 8])].append(i)
        covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
        n = len(words)
        out.append((doc_id, n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n))
    return out


def lines(rows, least: int = 10):
    strip = "\t\n\x0b\x0c\r "
    holds = defaultdict(set)
    for d, text in rows:
        for x in (text or "").split("\n"):
            k = x.strip(strip).translate(UPPER)
            if len(k) >= least:
                holds[k].add(d)
    out = []
    for d, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(k := x.strip(strip).translate(UPPER)) < least or min(holds[k]) == d]
        out.append((d, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def check_pieces(rows, found, length: int = 2048) -> float:
    """Whether each id lies in exactly one piece and sequences have no gaps; the share of padding."""
    t = tokenizer()
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert zlib.crc32(ids[d][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[d])
    padding = total = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / max(total + padding, 1)


def unigrams(rows):
    """Base scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    count: Counter = Counter()
    docs = []
    for d, text in rows:
        words = [*WORD.findall((text or "").translate(UPPER)), None]
        out = zlib.crc32(str(d).encode()) % 5 == 1
        docs.append((d, out, words))
        if not out:
            count.update(words)
    n, v = sum(count.values()), len(count)
    return [(d, o, len(w), sum(count[x] > 0 for x in w), n, sum(np.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, o, w in docs]
