"""Plain versions of the operators, one document after another."""

from __future__ import annotations

import math
import re
from collections import Counter

import xxhash


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def substring_dedup(docs: list[tuple], width: int) -> list[tuple]:
    """(id, n_words, n_removed, kept) in order."""
    every = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in every for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(docs, every, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def line_key(line: str) -> str:
    return ascii_lower(line.strip(" \t\n\x0b\x0c\r"))


def line_dedup(docs: list[tuple], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    """Documents are ids; rows of one id count once, and null ids are one document below all others."""
    holders: dict[str, set] = {}
    for k, t in docs:
        for key in {line_key(x) for x in (t or "").split("\n")}:
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(k)
    keep = {key: max(k for k in ids if k is not None) for key, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for k, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x) not in keep or keep[line_key(x)] == k]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text: str | None, size: int = 3) -> int:
    w = words(ascii_lower(text or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints: list[tuple[int, int]], radius: int = 2) -> dict[int, int]:
    """id -> least id reachable."""
    root = {k: k for k, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if (p ^ q).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k, _ in prints}


def measures(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = [False] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(again))
    return (*n, n[0] < 10 or 100 * n[4] > 20 * n[0])


def similar_groups(rows: list[tuple], least: float = 0.8) -> dict[int, int]:
    """id -> least id reachable over texts whose sets of 5-word shingles are similar."""
    sets = {}
    for k, t in rows:
        w = words(ascii_lower(t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def _bucket(value: int) -> int:
    over = max(value.bit_length() - 6, 0)
    return over * 32 + (value >> over)


def _top(number: int) -> int:
    """The largest value of a bucket."""
    value = number
    while _bucket(value) <= number:
        value += max(1, value >> 7)
    while _bucket(value) > number:
        value -= 1
    return value


def _limits(values: list[int], least: int, both: bool) -> tuple:
    """Least and largest value that pass, None where there is no fence."""
    held = sorted(_bucket(v) for v in values)
    n, different = len(held), sorted(set(held))
    share = {b: sum(x <= b for x in held) * 1_000_000 // n for b in different}
    if both:
        q1, q3 = (_top(min(b for b in different if sum(x <= b for x in held) >= q * n)) for q in (0.25, 0.75))
        reach = 6 * max(q3 - q1, least)
        return q1 - reach, q3 + reach
    for b in different:
        ahead = min((x for x in different if share[x] >= share[b] + 2001), default=different[-1])
        start, end = _top(b) + least, _top(ahead - 1) + 1 + least if ahead else least
        if share[b] >= 500_000 and ahead > b and end >= 2 * start:
            return None, math.floor(math.sqrt(start * end)) - least
    return None, None


def quality(rows: list[tuple], min_rows: int = 50) -> tuple[list[bool], list[tuple]]:
    """rows (text, lang, source) -> kept of each row, and the fences of all groups."""
    ratios = [(1, 0, 1000, 100, True), (2, 1, 10000, 200, False), (3, 0, 10000, 150, False), (4, 0, 10000, 700, False)]
    found = [measures(t) for t, _, _ in rows]
    value = lambda m, k: m[ratios[k][0]] * ratios[k][2] // m[ratios[k][1]] if m[ratios[k][1]] else 0
    good = [i for i, m in enumerate(found) if not m[-1]]
    kept, fences = [False] * len(rows), {}
    for i in good:
        levels = [[j for j in good if rows[j][1:] == rows[i][1:]], [j for j in good if rows[j][1] == rows[i][1]], good]
        pool = next((x for x in levels if len(x) >= min_rows), good)
        if rows[i][1:] not in fences:
            fences[rows[i][1:]] = [_limits([value(found[j], k) for j in pool], r[3], r[4]) for k, r in enumerate(ratios)]
        kept[i] = True
        for k, (low, high) in enumerate(fences[rows[i][1:]]):
            wider = (high - low) * 10 / max(found[i][0], 1) if low is not None else 0
            v = value(found[i], k)
            kept[i] &= (high is None or v <= high + wider) and (low is None or v >= low - wider)
    return kept, list(fences.values())


def leaks(text: str | None, items: list[tuple[int, str]], width: int = 5, least: float = 0.8) -> dict[int, float]:
    """Items with a window of their length that is similar enough, and the best similarity."""
    w, out = words(ascii_lower(text or "")), {}
    for item, t in items:
        own = words(ascii_lower(t or ""))
        k = min(width, len(own))
        if not own or len(w) < k:
            continue
        bag = Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
        n = min(len(own), len(w))
        for s in range(len(w) - n + 1):
            other = Counter(tuple(w[s + i : s + i + k]) for i in range(n - k + 1))
            similarity = sum((bag & other).values()) / sum((bag | other).values())
            if similarity >= least:
                out[item] = max(out.get(item, 0.0), similarity)
    return out


def path_probability(text: str, probability: dict[str, float], bare: float) -> float:
    """Log of the sum over all ways to spell text with pieces; other characters cost `bare`."""
    total = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            p = probability.get(text[start:end])
            if p is not None:
                total[end] += total[start] * p
            elif start == end - 1:
                total[end] += total[start] * bare
    return math.log(total[-1])


_M = (1 << 64) - 1


def _mix(x: int, salt: int = 0) -> int:
    x = (x ^ salt) & _M
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


def sampled_pieces(text: str, key: int, pieces: dict[str, int], log_p: list[float], byte_ids: list[int], seed: int = 0) -> list[int]:
    """Ids of one text: each part forward from its start, then drawn backward from its end, by the row's key and the place in the text."""
    row, out, longest = _mix(key, (seed * 0x9E3779B97F4A7C15 + 1) & _M), [], max(map(len, pieces))
    cuts = [k for k in range(1, len(text)) if text[k] == " " and text[k - 1] != " " or "\n" in text[k - 1 : k + 1]]
    for first, stop in zip([0, *cuts], [*cuts, len(text)], strict=True):
        part = text[first:stop]
        edges: list[list] = [[] for _ in range(len(part) + 1)]
        alpha = [0.0] * (len(part) + 1)
        for end in range(1, len(part) + 1):
            for width in range(1, min(end, longest) + 1):
                number = pieces.get(part[end - width : end], -1)
                if number >= 0 or width == 1:
                    edges[end].append((width, number, alpha[end - width] + log_p[number]))
            top = max(x for *_, x in edges[end])
            alpha[end] = top + math.log(sum(math.exp(x - top) for *_, x in edges[end]))
        own, at = [], len(part)
        while at:
            draw = (_mix((row + (first + at) * 0x9E3779B97F4A7C15) & _M) >> 11) * 2.0**-53
            upto = 0.0
            for width, number, x in edges[at]:
                upto += math.exp(x - alpha[at])
                if draw < upto:
                    break
            own.append([number] if number >= 0 else [byte_ids[b] for b in part[at - 1].encode()])
            at -= width
        out += [x for spelled in reversed(own) for x in spelled]
    return out
