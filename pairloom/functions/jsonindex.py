"""Structural index of many JSON texts at once, in whole-array steps.

All texts of a batch stand in one byte buffer. Bitmaps mark unescaped quotes, brackets and delimiters; running sums
of the quote bitmap give what lies in strings, running sums of the bracket bitmap the depth. From the marked bytes
come tokens, from the tokens the values with their parent, key and position. No text is parsed on its own, save
strings that hold escapes when they are read out.

Defined results: NULL, empty and cut-off texts, unbalanced brackets and any other breach of the grammar give no
values; of repeated keys in one object the last counts; JSON text written as a JSON string is read as that JSON.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np

OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA, STRING, SCALAR = range(8)

_CLASS = np.full(256, 255, np.uint8)
for _code, _char in enumerate("{}[]:,"):
    _CLASS[ord(_char)] = _code
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_SCALAR = re.compile(rb"(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)\Z")


@dataclass
class Values:
    """One row per value: its text, parent value (-1 at the root), key token span, position and byte span."""

    doc: np.ndarray
    parent: np.ndarray
    position: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    key_start: np.ndarray
    key_stop: np.ndarray
    data: bytes

    def text(self, i: int) -> str | None:
        """A value as text: strings without quotes, null as None, the rest as written."""
        raw = self.data[self.start[i] : self.stop[i]]
        if self.kind[i] == STRING:
            return json.loads(raw, strict=False) if b"\\" in raw else raw[1:-1].decode()
        return None if raw == b"null" else raw.decode()

    def keyed(self, name: str) -> np.ndarray:
        """Which values are members called ``name``; the last of repeated keys."""
        want = name.encode()
        hit = (self.key_stop - self.key_start == len(want) + 2) & (self.key_start >= 0)
        data = np.frombuffer(self.data, np.uint8)
        at = np.flatnonzero(hit)
        same = np.ones(len(at), bool)
        for j, byte in enumerate(want):
            same &= data[self.key_start[at] + 1 + j] == byte
        found = np.zeros(len(hit), bool)
        found[at[same]] = True
        escaped = np.flatnonzero((self.key_stop - self.key_start > len(want) + 2) & (self.key_start >= 0) & self._escaped_keys())
        for i in escaped:
            found[i] = json.loads(self.data[self.key_start[i] : self.key_stop[i]], strict=False) == name
        at = np.flatnonzero(found)
        last = np.ones(len(at), bool)
        order = np.lexsort((at, self.parent[at]))
        last[order[:-1]] = self.parent[at][order[:-1]] != self.parent[at][order[1:]]
        found[at[~last]] = False
        return found

    def _escaped_keys(self) -> np.ndarray:
        slashes = np.concatenate(([0], np.cumsum(np.frombuffer(self.data, np.uint8) == 92)))
        inside = np.maximum(self.key_start, 0), np.maximum(self.key_stop, 0)
        return slashes[inside[1]] > slashes[inside[0]]


def unwrapped(texts: list[str | None]) -> list[str]:
    """The texts with JSON strings that hold JSON opened; unreadable ones and NULLs are empty."""
    out = []
    for text in texts:
        if text is None:
            out.append("")
        elif text.lstrip()[:1] == '"':
            try:
                inner = json.loads(text)
                out.append(inner if isinstance(inner, str) else "")
            except ValueError:
                out.append("")
        else:
            out.append(text)
    return out


def _last_at_level(mark: np.ndarray, level: np.ndarray, depth: int) -> np.ndarray:
    """For each token the last marked token of the given level at or before it, -1 if none."""
    return np.maximum.accumulate(np.where(mark & (level == depth), np.arange(len(mark)), -1)) if len(mark) else mark.astype(int)


def index(texts: list[str | None]) -> Values:
    """The values of all texts, invalid texts left out."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in unwrapped(texts)]
    data = b"\n".join(encoded) + b"\n"
    lengths = np.fromiter((len(e) for e in encoded), np.int64, len(encoded)) + 1
    stops = np.cumsum(lengths)
    starts = stops - lengths
    b = np.frombuffer(data, np.uint8)[: stops[-1] if len(stops) else 0]
    if not len(b):
        return Values(*(np.zeros(0, np.int64) for _ in range(8)), data)
    n = len(b)
    slash = b == 92
    escaped = np.zeros(n, bool)
    if slash.any():  # a byte is escaped after an odd run of backslashes
        before = np.where(slash, -1, np.arange(n))
        run = np.arange(n) - np.maximum.accumulate(before)
        escaped[1:] = slash[:-1] & (run[:-1] % 2 == 1)
    quote = (b == 34) & ~escaped
    count = np.cumsum(quote)
    base = np.where(starts > 0, count[starts - 1], 0)
    per_doc = count[stops - 1] - base
    bad = per_doc % 2 == 1
    doc_of = np.repeat(np.arange(len(encoded)), lengths)
    inside = ((count - base[doc_of]) % 2 == 1) & ~quote
    opening = quote & ((count - base[doc_of]) % 2 == 1)
    control = inside & (b < 32)
    np.logical_or.at(bad, doc_of[np.flatnonzero(control)], True)
    kind_of = np.where(inside | quote, 255, _CLASS[b])
    plain = ~inside & ~quote & (kind_of == 255) & ~_SPACE[b]
    first = plain.copy()
    first[1:] &= ~plain[:-1]
    at = np.flatnonzero((kind_of != 255) | opening | first)
    kind = np.where(opening[at], STRING, np.where(first[at], SCALAR, kind_of[at])).astype(np.int64)
    doc = doc_of[at]
    if not len(at):
        return Values(*(np.zeros(0, np.int64) for _ in range(8)), data)
    stop = at + 1
    closing = np.flatnonzero(quote & ~opening)
    strings = kind == STRING
    where = np.searchsorted(closing, at[strings])
    stop[strings] = np.where(where < len(closing), closing[np.minimum(where, max(len(closing) - 1, 0))] if len(closing) else 0, 0) + 1
    last = plain.copy()
    last[:-1] &= ~plain[1:]
    stop[kind == SCALAR] = np.flatnonzero(last) + 1

    opens, closes = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY), (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)
    total = np.cumsum(opens.astype(np.int64) - closes)
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    counts = np.diff(np.concatenate((head, [len(at)])))
    depth = total - np.repeat(np.where(head > 0, total[head - 1], 0), counts)  # after the token
    end = np.repeat(depth[head + counts - 1], counts)
    np.logical_or.at(bad, doc[(depth < 0) | (end != 0)], True)
    level = np.where(opens, depth - 1, np.where(closes, depth, depth))  # of the container that holds the token
    level = np.where(closes, depth + 1, level)
    holder = np.full(len(at), -1)
    position = np.zeros(len(at), np.int64)
    token = np.arange(len(at))
    comma = kind == COMMA
    for d in range(1, int(depth.max(initial=0)) + 1):  # as many turns as the data is deep
        opener = np.maximum.accumulate(np.where(opens & (depth == d), token, -1))
        here = level == d
        holder[here] = opener[here]
        commas = np.cumsum(comma & here)
        position[here] = commas[here] - commas[opener[here]]
    stray = holder >= 0
    stray[stray] = doc[holder[stray]] != doc[stray]
    np.logical_or.at(bad, doc[stray], True)
    in_object = (holder >= 0) & (kind[holder] == OPEN_OBJECT)
    wrong = closes & (holder >= 0) & (kind[holder] != kind - 1)
    np.logical_or.at(bad, doc[wrong | (closes & (holder < 0))], True)

    previous = np.concatenate(([-1], kind[:-1]))
    previous[head] = -1
    following = np.concatenate((kind[1:], [-1]))
    following[head[1:] - 1] = -1
    is_key = strings & in_object & ((previous == OPEN_OBJECT) | (previous == COMMA))
    value = (opens | strings | (kind == SCALAR)) & ~is_key
    ended = np.isin(previous, (CLOSE_OBJECT, CLOSE_ARRAY, STRING, SCALAR))
    after_key = np.concatenate(([False], is_key[:-1]))
    after_key[head] = False
    fine = np.zeros(len(at), bool)
    fine |= value & ~in_object & (holder < 0) & (previous == -1)
    fine |= value & (holder >= 0) & ~in_object & np.isin(previous, (OPEN_ARRAY, COMMA))
    fine |= value & in_object & (previous == COLON)
    fine |= is_key & (following == COLON)
    fine |= (kind == COLON) & after_key
    fine |= comma & (holder >= 0) & ended & ~after_key
    fine |= (kind == CLOSE_OBJECT) & ((previous == OPEN_OBJECT) | ended & ~after_key)
    fine |= (kind == CLOSE_ARRAY) & ((previous == OPEN_ARRAY) | ended)
    np.logical_or.at(bad, doc[~fine], True)
    for i in np.flatnonzero((kind == SCALAR) & ~bad[doc]):
        if not _SCALAR.match(data, at[i], stop[i]):
            bad[doc[i]] = True

    closed = np.flatnonzero(closes & (holder >= 0))
    stop[holder[closed]] = at[closed] + 1
    keep = np.flatnonzero(value & ~bad[doc])
    number = np.full(len(at) + 1, -1)
    number[keep] = np.arange(len(keep))
    key = np.where(in_object[keep], keep - 2, -1)
    return Values(
        doc[keep], number[holder[keep]], position[keep], kind[keep], at[keep], stop[keep],
        np.where(key >= 0, at[key], -1), np.where(key >= 0, stop[key], -1), data,
    )


def children(values: Values, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of ``frontier``, which is an array, its elements: (index into frontier, element)."""
    order = np.argsort(values.parent, kind="stable")
    parents = values.parent[order]
    low, high = np.searchsorted(parents, frontier, "left"), np.searchsorted(parents, frontier, "right")
    counts = high - low
    source = np.repeat(np.arange(len(frontier)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return source, order[np.repeat(low, counts) + offset]


def walk(values: Values, path: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Follow ``path`` from every root; ``[]`` goes to the elements of an array, or takes a lone value as element 0.

    Gives the values reached and a matrix of the positions taken at each ``[]``. A null in place of an array has no
    elements.
    """
    at = np.flatnonzero(values.parent == -1)
    taken: list[np.ndarray] = []
    data = np.frombuffer(values.data, np.uint8)
    for step in path:
        if step == "[]":
            array = values.kind[at] == OPEN_ARRAY
            null = (values.kind[at] == SCALAR) & (data[values.start[at]] == ord("n"))
            source, element = children(values, at[array])
            lone = np.flatnonzero(~array & ~null)
            back = np.concatenate((np.flatnonzero(array)[source], lone))
            position = np.concatenate((values.position[element], np.zeros(len(lone), np.int64)))
            at, taken = np.concatenate((element, at[lone])), [*(t[back] for t in taken), position]
        else:
            member = np.flatnonzero(values.keyed(step))
            order = np.argsort(values.parent[member], kind="stable")
            member = member[order]
            spot = np.searchsorted(values.parent[member], at)
            hit = np.zeros(len(at), bool)
            inside = spot < len(member)
            hit[inside] = values.parent[member[spot[inside]]] == at[inside]
            at, taken = member[spot[hit]], [t[hit] for t in taken]
    return at, np.stack(taken, 1) if taken else np.zeros((len(at), 0), np.int64)
