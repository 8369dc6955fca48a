"""Personal data: fixed patterns, and spans added by a bidirectional LSTM over characters with CRF transitions."""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import documents, map_slices, spread

KINDS = ("email", "ip", "card", "phone")
#: The model learns from so many windows at most: a quarter hold pattern spans, a quarter none, and into half of them forms that the patterns
#: miss, or that only look like personal data, are written. They come from at most so many documents, by a hash of their id.
TRAIN_DOCS = 20_000
TRAIN_WINDOWS = 12_000
#: Characters of a window and between the starts of two.
WIDTH = 64
STRIDE = 32
HIDDEN = 24
STEPS = 900
BATCH = 96
#: Windows decoded at once.
DECODED = 2048

TAGS = 1 + 2 * len(KINDS)
CLASSES = 65

# The patterns of the four kinds. The email's parts are matched around each '@'; see emails().
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Where the patterns can match at all; and where the model looks besides: marks of spelled-out addresses.
TRIGGER = re.compile(r"[0-9@]")
SPELLED = re.compile(r"[0-9@]|[\[({<] ?(?:at|dot) ?[\])}>]|\bdot\b", re.I)

Span = tuple[int, int, str]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of a local part, '@' and a domain with a dot: the local part is all of the run before the '@'."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in s.split(".")))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then in the order of KINDS; matches that fail a kind's check are dropped."""
    found = [(a, b, 0) for a, b in emails(text)]
    if TRIGGER.search(text):
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if _is_ip(m[0])]
        found += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    found.sort(key=lambda s: (s[0], s[2], s[1]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def _classes() -> np.ndarray:
    """The class of each code point below 0x2000, then that of all others: digits are one, letters count without case, accented ones by block."""
    table = np.full(0x2001, 2, np.uint8)
    table[0], table[10], table[0xC0:0x250], table[0x370:0x2000] = 0, 1, 3, 4
    shown = [chr(c) for c in range(32, 127) if not chr(c).isalnum()]
    for k, c in enumerate(shown):
        table[ord(c)] = 5 + k
    for k, c in enumerate(string.ascii_lowercase):
        table[ord(c)] = table[ord(c.upper())] = 5 + len(shown) + k
    table[48:58] = 5 + len(shown) + 26
    return table


_table = _classes()


def codes(text: str) -> np.ndarray:
    """A class below CLASSES for each character."""
    return _table[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x2000)]


def windows(text: str) -> np.ndarray:
    """Starts of the overlapping windows that hold a digit, '@' or a spelled-out 'at' or 'dot', without which no kind is known here; each such place is in two where the text allows."""
    at = np.fromiter((m.start() for m in SPELLED.finditer(text)), np.int64)
    if not len(at):
        return at
    k = np.unique(np.concatenate([at // STRIDE, np.maximum(at // STRIDE - 1, 0)]))
    return k * STRIDE


def cut(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([values, np.zeros(WIDTH, values.dtype)])
    return padded[starts[:, None] + np.arange(WIDTH)]


def tag(n: int, spans: list[Span]) -> np.ndarray:
    """0 outside, 2 k + 1 at the start of kind k and 2 k + 2 inside; earlier spans come first where two overlap."""
    out = np.zeros(n, np.uint8)
    for a, b, kind in reversed(spans):
        out[a:b] = 2 * KINDS.index(kind) + 2
        out[a] = 2 * KINDS.index(kind) + 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Weights of both directions stacked: gates from characters and from the state, emissions from both states, transitions, first tags."""

    x: np.ndarray
    h: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    NAMES = ("x", "h", "out", "bias", "moves", "first")

    @staticmethod
    def start(seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        x = n(2, CLASSES, 4 * HIDDEN)
        x[:, :, HIDDEN : 2 * HIDDEN] += 0.5
        return Tagger(x, n(2, HIDDEN, 4 * HIDDEN), n(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), n(TAGS, TAGS), np.zeros(TAGS, np.float32))

    def states(self, chars: np.ndarray, keep: bool = False):
        """States of each direction at each place; with keep also what the way back needs."""
        b, t = chars.shape
        both = np.stack([chars, chars[:, ::-1]])
        hs, cs, gates = np.zeros((t + 1, 2, b, HIDDEN), np.float32), np.zeros((t + 1, 2, b, HIDDEN), np.float32), []
        for k in range(t):
            z = np.stack([self.x[0][both[0, :, k]], self.x[1][both[1, :, k]]]) + hs[k] @ self.h
            g = np.concatenate([_sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])], axis=-1)
            i, f, o, c = (g[..., j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            cs[k + 1] = f * cs[k] + i * c
            hs[k + 1] = o * np.tanh(cs[k + 1])
            if keep:
                gates.append(g)
        return (both, hs, cs, gates) if keep else hs

    def emissions(self, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """b, t, tags scores and the joined states they come from."""
        joined = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=-1).transpose(1, 0, 2)
        return joined @ self.out + self.bias, joined

    def loss(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the tags for each window, and its gradients."""
        b, t = chars.shape
        both, hs, cs, gates = self.states(chars, keep=True)
        e, joined = self.emissions(hs)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = self.first + e[:, 0]
        for k in range(1, t):
            alpha[:, k] = _logsumexp(alpha[:, k - 1, :, None] + self.moves, 1) + e[:, k]
        for k in range(t - 2, -1, -1):
            beta[:, k] = _logsumexp(self.moves + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = _logsumexp(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None])
        rows, cols = np.arange(b)[:, None], np.arange(t)[None, :]
        score = self.first[tags[:, 0]] + e[rows, cols, tags].sum(axis=1) + self.moves[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        ge = marginal
        gfirst = marginal[:, 0].sum(axis=0) - np.bincount(tags[:, 0], minlength=TAGS)
        ge[rows, cols, tags] -= 1
        pairs = np.exp(alpha[:, :-1, :, None] + self.moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        gmoves = pairs - np.bincount(tags[:, :-1].astype(np.int64).ravel() * TAGS + tags[:, 1:].ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        gout = joined.reshape(-1, 2 * HIDDEN).T @ ge.reshape(-1, TAGS)
        gj = (ge @ self.out.T).transpose(1, 0, 2)
        from_out = np.stack([gj[:, :, :HIDDEN], gj[::-1, :, HIDDEN:]], axis=1)
        gx, gh = np.zeros_like(self.x), np.zeros_like(self.h)
        dh, dc = np.zeros((2, b, HIDDEN), np.float32), np.zeros((2, b, HIDDEN), np.float32)
        for k in range(t - 1, -1, -1):
            dh = dh + from_out[k]
            i, f, o, c = (gates[k][..., j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            tc = np.tanh(cs[k + 1])
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * c * i * (1 - i), dc * cs[k] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c * c)], axis=-1)
            gh += hs[k].transpose(0, 2, 1) @ dz
            for d in (0, 1):
                hot = np.zeros((b, CLASSES), np.float32)
                hot[np.arange(b), both[d, :, k]] = 1
                gx[d] += hot.T @ dz[d]
            dh = dz @ self.h.transpose(0, 2, 1)
            dc = dc * f
        gradients = {"x": gx, "h": gh, "out": gout, "bias": ge.sum(axis=(0, 1)), "moves": gmoves, "first": gfirst}
        return float((z - score).mean()), {k: (v / b).astype(np.float32) for k, v in gradients.items()}

    def fit(self, chars: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 9) -> Tagger:
        """Adam over random batches; the rate falls to zero."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in self.NAMES} for _ in range(2))
        for step in range(1, steps + 1):
            at = rng.integers(0, len(chars), min(BATCH, len(chars)))
            _, g = self.loss(chars[at], tags[at])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                rate = 0.02 * (1 - step / (steps + 1))
                setattr(self, k, getattr(self, k) - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32))
        return self

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tags of each window."""
        e, _ = self.emissions(self.states(chars))
        b, t, _ = e.shape
        best, back = self.first + e[:, 0], np.zeros((t, b, TAGS), np.uint8)
        for k in range(1, t):
            all_ways = best[:, :, None] + self.moves
            back[k] = all_ways.argmax(axis=1)
            best = all_ways.max(axis=1) + e[:, k]
        out = np.zeros((b, t), np.uint8)
        out[:, -1] = best.argmax(axis=1)
        for k in range(t - 1, 0, -1):
            out[:, k - 1] = back[k, np.arange(b), out[:, k]]
        return out


def reconciled(n: int, starts: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """One tag for each of a text's characters: where windows overlap, that of the window in which it stands further from the edge."""
    out, depth = np.zeros(n + WIDTH, np.uint8), np.full(n + WIDTH, -1, np.int16)
    inner = np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1]).astype(np.int16)
    for s, own in zip(starts.tolist(), tags):
        edge = inner.copy()
        if s == 0:
            edge[: WIDTH // 2] = WIDTH
        better = edge > depth[s : s + WIDTH]
        out[s : s + WIDTH][better] = own[better]
        depth[s : s + WIDTH][better] = edge[better]
    return out[:n]


def tagged_spans(tags: np.ndarray) -> list[Span]:
    """Spans of equal kind; a start tag opens a new one."""
    kind = (tags.astype(np.int64) + 1) // 2
    found, k, n = [], 0, len(tags)
    for k in np.flatnonzero(np.diff(kind, prepend=0) | (tags % 2 == 1)).tolist():
        if kind[k]:
            end = k + 1
            while end < n and kind[end] == kind[k] and tags[end] % 2 == 0:
                end += 1
            found.append((k, end, KINDS[kind[k] - 1]))
    return found


def plausible(s: str, kind: str) -> bool:
    """What an added span must have at least: the digits, parts or marks without which it is not of its kind."""
    d = _digits(s)
    if kind == "email":
        name, mark, host = re.match(r"(.*?)(@|\bat\b)(.*)", s + " ", re.S | re.I).groups() if re.search(r"@|\bat\b", s, re.I) else ("", "", "")
        return bool(re.search(r"\w", name) and re.search(r"\w\W*(\.|\bdot\b)\W*\w", host, re.I))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and bool(re.search(r"[0-9][^0-9]+[0-9]", s))


def _number(rng: random.Random, n: int, first: str = "123456789") -> str:
    return rng.choice(first) + "".join(rng.choice(string.digits) for _ in range(n - 1))


def _name(rng: random.Random) -> str:
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))


def _card(rng: random.Random, valid: bool = True) -> tuple[str, tuple[int, ...]]:
    sizes = rng.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5)])
    body = _number(rng, sum(sizes) - 1, "3456")
    check = next(c for c in string.digits if luhn(body + c))
    return body + (check if valid else str((int(check) + rng.randint(1, 9)) % 10)), sizes


def _groups(digits: str, sizes: tuple[int, ...], mark: str) -> str:
    at = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    return mark.join(digits[a:b] for a, b in zip(at, at[1:]))


def written_form(rng: random.Random, kind: str) -> str:
    """A made-up item of a kind in one of the forms that the patterns miss."""
    if kind == "email":
        name, host = rng.choice(["{a}", "{a}.{b}", "{a}_{b}", "{a}{n}"]).format(a=_name(rng), b=_name(rng), n=rng.randint(1, 99)), [_name(rng), rng.choice(["com", "org", "net", "de", "fr", "es", "io", "edu", "info"])]
        if rng.random() < 0.3:
            host.insert(0, rng.choice(["mail", "mx", "web"]) + rng.choice(["", str(rng.randint(1, 9))]))
        at = rng.choice([" @ ", " @ ", " @ ", " @", "@ ", " [at] ", "[at]", " (at) ", "(at)", " at ", " at ", " at ", "{at}", " <at> "])
        dot = rng.choice([" dot ", "[dot]", "(dot)", " [dot] ", "."]) if at.strip() != "at" else rng.choice([" dot ", " [dot] "])
        s = name + at + dot.join(host) if "@" not in at or at != "@ " else name + at + ".".join(host)
        return s.upper() if rng.random() < 0.05 else s.replace("at", "AT", 1).replace("dot", "DOT") if rng.random() < 0.1 and "at" in at else s
    if kind == "ip":
        parts = [str(rng.choice([rng.randint(0, 255), rng.randint(0, 30), 0, 1, 10, 192, 255])) for _ in range(4)]
        return rng.choice([" . ", ". ", " .", "[.]", "(.)", " dot ", "-", " [.] "]).join(parts)
    if kind == "card":
        digits, sizes = _card(rng)
        return _groups(digits, sizes, rng.choice([".", "/", "_", "  ", " - ", "--", ":", " / ", ","]))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4, string.digits)
    local = rng.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"{a}/{b}{c}", f"{a} {b}-{c}", f"({a}) {b}.{c}"])
    if rng.random() < 0.2:
        return rng.choice(["1-", "1 ", "1.", "001 ", "001-", "0"]) + local
    if rng.random() < 0.15:
        return " ".join(["0" + rng.choice("123456789")] + [_number(rng, 2, string.digits) for _ in range(4)])
    if rng.random() < 0.1:
        return f"0{_number(rng, 2)}{rng.choice(['/', ' ', '-'])}{_number(rng, rng.choice([7, 8]))}"
    return local


def look_alike(rng: random.Random) -> str:
    """Something with digits or marks that is of no kind."""
    d = lambda n: _number(rng, n)
    kinds = [
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 31):02}",
        lambda: f"{rng.randint(1, 31)}{(m := rng.choice('./'))}{rng.randint(1, 12)}{m}{rng.randint(1900, 2099)}",
        lambda: f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
        lambda: ".".join(d(rng.randint(1, 2)) for _ in range(rng.choice([2, 3, 3, 5, 6]))),
        lambda: f"{rng.choice('$€£')}{d(rng.randint(1, 3))},{d(3)}.{d(2)}",
        lambda: "".join(rng.choice(string.digits + "abcdef") for _ in range(rng.randint(8, 40))),
        lambda: d(rng.randint(1, 8)),
        lambda: d(rng.randint(9, 20)),
        lambda: f"{d(3)}-{d(4)}",
        lambda: f"{d(4)}-{d(4)}",
        lambda: f"{d(4)}/{d(2)}",
        lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)),
        lambda: f"{rng.randint(1, 90)}.{d(rng.randint(3, 6))}, -{rng.randint(1, 90)}.{d(rng.randint(3, 6))}",
        lambda: f"@{_name(rng)}",
        lambda: f"{_name(rng)} @ {rng.randint(1, 12)}",
        lambda: f"{_name(rng)} at {_name(rng)}",
        lambda: f"{_name(rng)} at the dot {_name(rng)}",
        lambda: f"{_name(rng)} dot {_name(rng)}",
        lambda: f"[{d(1)}]",
        lambda: f"({rng.randint(1900, 2099)})",
    ]
    return rng.choice(kinds)()


def shapes(text: str) -> list[Span]:
    """What the model learns to mark: the pattern spans, and numbers that only fail as cards by their last digit, which no tagger can add up.

    Such a number is never added: plausible() does the sum.
    """
    cards = [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= len(_digits(m[0])) <= 19] if TRIGGER.search(text) else []
    return sorted({*base_spans(text), *cards})


def planted(text: str, rng: random.Random) -> tuple[str, list[Span]]:
    """WIDTH characters of a text with a form or a look-alike written between two of its words, or cut off at an edge; and the spans in them."""
    kind = rng.choice((*KINDS, "email", "", ""))
    s = written_form(rng, kind) if kind else look_alike(rng)
    spaces = [k for k, c in enumerate(text) if c == " "] or [0]
    at = rng.choice(spaces) + 1
    s_end = rng.choice([" ", " ", ", ", ". ", ") ", "; ", "\n", "%%% ", "$$$ ", "! "])
    lead = rng.choice(["", "", "", "", "(", "tel ", "Tel. ", "mail ", "ip ", ": ", "\n"])
    whole = text[:at] + lead + s + s_end + text[at:]
    start, found = at + len(lead), [(at + len(lead), at + len(lead) + len(s), kind)] if kind else []
    a = max(0, min(start - rng.randint(-len(s) // 2, WIDTH - len(s) // 2), max(0, len(whole) - WIDTH)))
    return whole[a : a + WIDTH], [(max(x - a, 0), min(y - a, WIDTH), k) for x, y, k in found if y > a and x < a + WIDTH]


def train(df: DataFrame, docs: int = TRAIN_DOCS, most: int = TRAIN_WINDOWS, text: str = "text", key: str = "doc_id") -> Tagger | None:
    """Learns from labelled windows of at most `docs` documents; None where there is no text.

    Labels are the pattern spans, and items that are written into other windows in forms that the patterns miss. Rows are taken by a hash of
    their id, windows by a hash of what they hold; rows without an id or text teach nothing.
    """
    rows = documents(df, text=text, key=key).where("doc_id IS NOT NULL AND text IS NOT NULL")
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs).distinct()
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")
    schema = T.StructType([T.StructField("chars", T.StringType()), T.StructField("tags", T.BinaryType()), T.StructField("some", T.BooleanType())])

    def make():
        def step(part: pa.RecordBatch) -> list:
            chars, tags = [], []
            for t in part.column("text").to_pylist():
                own = tag(len(t), shapes(t))
                starts = np.union1d(windows(t), np.arange(0, len(t), 40 * WIDTH))
                chars += [t[s : s + WIDTH] for s in starts.tolist()]
                tags += [own[s : s + WIDTH].tobytes() for s in starts.tolist()]
            return [chars, tags, [any(x) for x in tags]]

        return step

    found = map_slices(spread(sample), make, schema).distinct()
    h = F.xxhash64("chars", "tags")
    held = found.where("some").orderBy(h, "chars").limit(most // 4).collect()
    bare = found.where("NOT some").orderBy(h, "chars").limit(most * 3 // 4).collect()
    if not held and not bare:
        return None
    rng = random.Random(11)
    examples = [(r.chars, np.frombuffer(bytes(r.tags), np.uint8)) for r in held + bare[: most // 4]]
    plain = [r.chars for r in bare[most // 4 :]] or [r.chars for r in bare] or [""]
    for k in range(most // 2):
        words, spans = planted(plain[k % len(plain)], rng)
        examples.append((words, tag(len(words), spans)))
    chars, tags = np.zeros((len(examples), WIDTH), np.uint8), np.zeros((len(examples), WIDTH), np.uint8)
    for k, (words, own) in enumerate(examples):
        chars[k, : len(words)], tags[k, : len(own)] = codes(words), own
    return Tagger.start().fit(chars, tags)


def snapped(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without white space and closing marks at its ends; with the whole of a run of letters and digits where it begins or ends within one."""
    while a < b and text[a] in " \n\t,;:":
        a += 1
    while b > a and text[b - 1] in " \n\t.,;:!?-/":
        b -= 1
    if a < b:
        while a > 0 and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
    return a, b


def added_spans(model: Tagger, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """For each text the model's spans that no pattern span overlaps: windows of all texts are decoded together, then reconciled text by text."""
    starts = [windows(t) for t in texts]
    pieces = [cut(codes(t), s) for t, s in zip(texts, starts) if len(s)]
    if not pieces:
        return [[] for _ in texts]
    chars = np.concatenate(pieces)
    tags = np.concatenate([model.decode(chars[k : k + DECODED]) for k in range(0, len(chars), DECODED)])
    out, at = [], 0
    for t, s, base in zip(texts, starts, bases):
        found = []
        if len(s):
            for a, b, kind in tagged_spans(reconciled(len(t), s, tags[at : at + len(s)])):
                a, b = snapped(t, a, b)
                if a < b and not any(a < y and x < b for x, y, _ in base) and plausible(t[a:b], kind):
                    found.append((a, b, kind))
            at += len(s)
        out.append(found)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))


def find(df: DataFrame, model: Tagger | None, keep: tuple[str, ...] = (), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text, the columns in keep, and found: start, end (code points, exclusive), kind, base (whether a pattern's) by start, then kind.

    Pattern spans always stay; the model adds plausible spans that overlap none of them. Null and empty texts have no spans; without a model
    nothing is added; repeated rows give a row each.
    """
    docs = spread(documents(df, *keep, text=text, key=key))
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[n] for n in ("doc_id", "text", *keep)] + [T.StructField("found", SPANS)])

    def make():
        model = sent.value

        def step(part: pa.RecordBatch) -> list:
            texts = [t or "" for t in part.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = added_spans(model, texts, bases) if model else [[] for _ in texts]
            found = []
            for base, more in zip(bases, added):
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                found.append([{"start": a, "end": b, "kind": k, "base": y} for a, b, k, y in spans])
            return [part.column("doc_id"), part.column("text"), *(part.column(k) for k in keep), found]

        return step

    return map_slices(docs, make, schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the pattern spans, spans (all of them), n_added."""
    base = F.filter("found", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redacted(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text with every span replaced by its kind in square brackets, the columns in keep; spans that overlap an earlier one merge into it."""
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    text = F.aggregate("found", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    return found.select("doc_id", F.when(F.size("found") > 0, text).otherwise(F.col("text")).alias("text"), *keep)
