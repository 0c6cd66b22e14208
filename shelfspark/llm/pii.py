"""Personal data: base patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are runs without white space; their word shape (digits, letters, dots, signs, counted in bounded
steps) and the shapes of their neighbours are the features. The field is trained on the driver from a small
labelled table and decoded by Viterbi in numpy. A token whose own evidence for "nothing" exceeds what any
neighbour could change is certain, so chains are cut there without changing the best path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, with_column

KINDS = ("email", "ip", "card", "phone")
SLICE_BYTES = 512 << 10  # of text at once, as the code points, token shapes and chains of a slice are all held together
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and anchored to the start of a run of digits: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns by kind, then start, in code points."""
    found = _emails(text)
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


# --- fixed values: the small labelled table. [kind text] marks a span ------------------------
LABELLED = """
write to [email anna.holm@post.example.org] before noon
mail [email j_doe+news@shop-mail.example.com] or call [phone +49 (030) 555-0134] today
contact [email info@example.net] for details about the meeting
the address [email sales@a1.example.co.uk] is no longer read
reach me under [email max@mustermann.example.de], thanks
her mail was [email k.l99@uni.example.edu] in those years
server [ip 10.0.0.12] did not answer the second request
login from [ip 192.168.14.250] at night was refused
the host [ip 203.0.113.7] and the host [ip 198.51.100.23] were down
blocked [ip 172.16.254.1] after three attempts
from [ip 8.8.4.4] to [ip 185.12.64.90] the route is short
paid with [card 4111111111111111] on the same day
card [card 5500 0000 0000 0004] was declined at the desk
the number [card 4012-8888-8888-1881] is stored nowhere
charge [card 6011000990139424] for the second order
use [card 3530 1113 3330 0000] until the end of the year
please call [phone +1 (212) 555-0199] between nine and five
phone [phone +44 20 7946 0958] or write a letter
ring [phone +33 1 99 00 12 34] in the morning
my number is [phone +81-3-5550-0123] since june
text [phone +1 (415) 555-2671] when you arrive
the meeting in 2019 had 45 guests and 3 speakers
chapter 12 section 3.4 of version 2.10.1 explains the rule
it costs 1,299.00 in total or 15% less on 24-12-2020
order 883712 was sent in 4 boxes of 12 pieces
between 1914 and 1918 about 70000000 people served
the ratio is 0.75 and the error is 1e-9 at most
room b12 on floor 7 opens at 08:30 and closes at 17:45
see figure 5-2 and table a.3 for the 2nd and 3rd case
page 404 of 512 shows item no. 20394 with price $$$ 12
password=1f3a9c77 token = "90ab77ffcd012345" key AKIA77PQ12XY
at 100 km/h the trip takes 3 h 20 min
this is a plain sentence without any number at all
und so weiter bis zum ende der geschichte
the price*** was### low&&& and%%% the$$$ end*** came###
score 3-1 in minute 87 and 2 + 2 = 4 @ home
a@ b and @c are not addresses
"""


@dataclass
class Example:
    tokens: list[str]
    labels: list[int]


def labelled_table() -> list[Example]:
    """Tokens with labels (0 none, then 1 + kind) of each labelled line."""
    examples = []
    for line in LABELLED.strip().split("\n"):
        tokens, labels = [], []
        for marked, kind, inner in re.findall(r"(\[(\w+) ([^\]]+)\]\S*|\S+)", line):
            words = (inner + marked.rpartition("]")[2]).split() if kind in KINDS else [marked]
            tokens += words
            labels += [KINDS.index(kind) + 1 if kind in KINDS else 0] * len(words)
        examples.append(Example(tokens, labels))
    return examples


# Shape features of a token: (name, number of values). Counts are cut to steps, so shapes are bounded.
_STEPS = np.array([0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 6, 6, 7, 7, 7, 8, 9, 9, 9, 9, 10])
FEATURES = (("digits", 11), ("letters", 2), ("at", 2), ("dots", 5), ("plus", 2), ("paren", 2), ("dash", 2), ("sign", 2))
SHAPES = int(np.prod([n for _, n in FEATURES]))
LABELS = 1 + len(KINDS)


def _classes() -> np.ndarray:
    """Class of each code point below 256: 0 other sign, 1 blank, 2 digit, 3 letter, 4 at, 5 dot, 6 plus, 7 paren, 8 dash, 9 mark."""
    table = np.zeros(256, np.uint8)
    table[[32, *range(9, 14)]] = 1
    table[48:58] = 2
    table[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = 3
    for code, kind in (("@", 4), (".", 5), ("+", 6), ("(", 7), (")", 7), ("-", 8), (",", 9), (";", 9), (":", 9), ("!", 9), ("?", 9)):
        table[ord(code)] = kind
    return table


_CLASS = _classes()


def shape_parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens in code points, and their shape features, one column each."""
    kind = np.where(codes < 256, _CLASS[np.minimum(codes, 255)], 3)
    inside = np.concatenate([[False], kind != 1, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros((0, len(FEATURES)), np.int64)

    def count(k: int) -> np.ndarray:
        return np.add.reduceat((kind == k).astype(np.int32), starts)

    # A dot that ends a token is punctuation.
    dots = count(5) - (kind[ends - 1] == 5)
    parts = [_STEPS[np.minimum(count(2), 20)], count(3) > 0, count(4) > 0, np.minimum(dots, 4), kind[starts] == 6,
             count(7) > 0, count(8) > 0, count(0) > 0]
    return starts, ends, np.stack([p.astype(np.int64) for p in parts], axis=1)


def shape_ids(parts: np.ndarray) -> np.ndarray:
    ids = np.zeros(len(parts), np.int64)
    for k, (_, n) in enumerate(FEATURES):
        ids = ids * n + parts[:, k]
    return ids


def _one_hot(parts: np.ndarray) -> np.ndarray:
    """Each feature value, and each pair of digit step with another feature value, as 0/1 columns."""
    columns = [np.eye(n)[parts[:, k]] for k, (_, n) in enumerate(FEATURES)]
    columns += [(columns[0][:, :, None] * c[:, None, :]).reshape(len(parts), -1) for c in columns[1:]]
    return np.concatenate([*columns, np.ones((len(parts), 1))], axis=1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


@dataclass
class Crf:
    """Log potentials: of a shape for its own token, for the next and for the previous one, and of label pairs."""
    own: np.ndarray
    after: np.ndarray
    before: np.ndarray
    pairs: np.ndarray

    def emissions(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        e = self.own[ids]
        e[1:] += np.where(first[1:, None], 0, self.after[ids[:-1]])
        e[:-1] += np.where(last[:-1, None], 0, self.before[ids[1:]])
        return e

    def decode(self, ids: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best labels of all tokens; `line` numbers the chain each token belongs to."""
        labels = np.zeros(len(ids), np.int64)
        if not len(ids):
            return labels
        first = np.concatenate([[True], line[1:] != line[:-1]])
        last = np.concatenate([first[1:], [True]])
        e = self.emissions(ids, first, last)
        # Changing a token to "none" gains more than its two neighbours can ever lose.
        certain = e[:, 0] - e[:, 1:].max(axis=1) > 2 * (self.pairs.max() - self.pairs.min())
        open_ = np.flatnonzero(~certain)
        if not len(open_):
            return labels
        begins = np.flatnonzero((np.diff(open_, prepend=open_[0] - 2) > 1) | first[open_])
        size = np.diff(np.append(begins, len(open_)))
        order = np.argsort(-size, kind="stable")
        head, size = open_[begins[order]], size[order]
        # The label before a chain is "none" if a certain token stands there.
        best = e[head] + np.where(first[head][:, None], 0, self.pairs[0])
        back = []
        for t in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -t))  # chains with more than t tokens
            step = best[:n, :, None] + self.pairs
            back.append(step.argmax(axis=1))
            best[:n] = step.max(axis=1) + e[head[:n] + t]
        tail = head + size - 1
        best = best + np.where(last[tail][:, None], 0, self.pairs[:, 0])
        now = best.argmax(axis=1)
        labels[tail] = now
        for t in range(int(size[0]) - 1, 0, -1):
            n = len(back[t - 1])
            now[:n] = back[t - 1][np.arange(n), now[:n]]
            labels[head[:n] + t - 1] = now[:n]
        return labels

    def spans(self, text: str) -> list[Span]:
        return self.batch_spans([text])[0]

    def batch_spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans of runs of equally labelled tokens of a line, trimmed of punctuation."""
        out: list[list[Span]] = [[] for _ in texts]
        codes = _codes("\n".join(texts))
        starts, ends, parts = shape_parts(codes)
        breaks = np.cumsum(codes == 10)
        line = breaks[starts] if len(starts) else starts
        labels = self.decode(shape_ids(parts), line)
        hits = np.flatnonzero(labels)
        if not len(hits):
            return out
        offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        cut = np.flatnonzero((np.diff(hits, prepend=hits[0] - 2) > 1) | (np.diff(labels[hits], prepend=-1) != 0)
                             | (np.diff(line[hits], prepend=-1) != 0))
        for a, b in zip(cut, np.append(cut[1:], len(hits))):
            lo, hi, kind = int(starts[hits[a]]), int(ends[hits[b - 1]]), KINDS[labels[hits[a]] - 1]
            which = int(np.searchsorted(offset, lo, "right")) - 1
            lo, hi, text = lo - int(offset[which]), hi - int(offset[which]), texts[which]
            while lo < hi and not (text[lo].isalnum() or text[lo] in "+("):
                lo += 1
            while hi > lo and not text[hi - 1].isalnum():
                hi -= 1
            if lo < hi:
                out[which].append((kind, lo, hi))
        return out


def train(examples: list[Example] | None = None, rounds: int = 400, rate: float = 0.1, ridge: float = 0.01) -> Crf:
    """Maximise the conditional likelihood of the labelled table by Adam; deterministic."""
    examples = examples or labelled_table()
    data = []
    for example in examples:
        _, _, parts = shape_parts(_codes(" ".join(example.tokens)))
        data.append((_one_hot(parts), np.array(example.labels)))
    width = data[0][0].shape[1]
    weights = np.zeros((3 * width + LABELS, LABELS))  # own, after, before, pairs
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        grad = -ridge * weights
        pairs = weights[3 * width:]
        for x, y in data:
            n = len(y)
            prev, nxt = np.zeros_like(x), np.zeros_like(x)
            prev[1:], nxt[:-1] = x[:-1], x[1:]
            full = np.concatenate([x, prev, nxt], axis=1)
            e = full @ weights[:3 * width]
            alpha, beta = np.zeros((n, LABELS)), np.zeros((n, LABELS))
            alpha[0] = e[0]
            for t in range(1, n):
                alpha[t] = e[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + pairs, axis=0)
            for t in range(n - 2, -1, -1):
                beta[t] = np.logaddexp.reduce(pairs + (e[t + 1] + beta[t + 1])[None], axis=1)
            z = np.logaddexp.reduce(alpha[-1])
            gap = np.eye(LABELS)[y] - np.exp(alpha + beta - z)
            grad[:3 * width] += full.T @ gap
            for t in range(1, n):
                grad[3 * width + y[t - 1], y[t]] += 1
                grad[3 * width:] -= np.exp(alpha[t - 1][:, None] + pairs + (e[t] + beta[t])[None] - z)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        weights += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    grid = np.stack(np.unravel_index(np.arange(SHAPES), [n for _, n in FEATURES]), axis=1)
    every = _one_hot(grid)
    own, after, before = (every @ weights[k * width:(k + 1) * width] for k in range(3))
    return Crf(own, after, before, weights[3 * width:])


def all_spans(texts: list[str | None], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and base spans with the field's spans that overlap none, by kind and start."""
    whole = [t or "" for t in texts]
    result = []
    for text, extra in zip(whole, crf.batch_spans(whole) if whole else []):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        free = []
        at = 0
        for span in sorted(extra, key=lambda s: s[1]):
            while at < len(taken) and taken[at][1] <= span[1]:
                at += 1
            if all(b <= span[1] or a >= span[2] for a, b in taken[max(at - 8, 0):at + 8]):
                free.append(span)
        result.append((base, sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return result


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find(docs: DataFrame, crf: Crf) -> DataFrame:
    """(doc_id, base, spans) of every row: spans as kind:start:end in code points, joined by commas.

    Null and empty texts have none. Rows with equal or null ids are rows of their own.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = all_spans(batch.column("text").to_pylist(), crf)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([joined(b) for b, _ in found], pa.string()),
                                           pa.array([joined(s) for _, s in found], pa.string())], ["doc_id", "base", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(narrow, "text", work, "doc_id long, base string, spans string", SLICE_BYTES)


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, crf: Crf) -> DataFrame:
    """The documents with personal data replaced in `text`; texts without any, and nulls, stay as they are.

    `n_chars`, where it is a number, is the length of the new text.
    """
    sized = dict(docs.dtypes).get("n_chars") in ("bigint", "int")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        new = [redact_text(t, spans) if spans else t for t, (_, spans) in zip(texts, all_spans(texts, crf))]
        if sized:
            kind = batch.schema.field("n_chars").type
            old = batch.column("n_chars").to_pylist()
            counts = [n if a == b or n is None else len(b) for n, a, b in zip(old, texts, new)]
            batch = with_column(batch, "n_chars", pa.array(counts, kind))
        return with_column(batch, "text", pa.array(new, batch.schema.field("text").type))

    return map_slices(docs, "text", work, docs.schema, SLICE_BYTES)
