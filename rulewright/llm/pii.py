"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds what they miss.

The base patterns find e-mail addresses, IP addresses, card and phone numbers in their usual forms; their spans always
stay. The field looks at what lies outside them: stretches of text that could hold such data in another form ("jane
at mail dot example dot com", "(743) 555-3824", "4111.1111.1111.1111", "192 . 168 . 0 . 12"), and keys and passwords,
which are a kind of their own beside the four. A stretch is cut into tokens; features of a whole candidate segment (its digits, separators, checksum, neighbours) score it for each kind,
and dynamic programming over segments of at most MAX_TOKENS tokens chooses boundaries and kinds together. A stretch runs
to the real end of its digits and separators, and is decoded once as a whole, in memory that grows with its tokens.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SECRET = 4  # the field's fifth label: keys, tokens and passwords, which have no base pattern
LABELS = (*KINDS, "secret")
MAX_TOKENS = 24
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match begins where a run of digits does, and runs are taken whole: the matches of the plain pattern, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind and start."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((0, start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


# ---- the field ------------------------------------------------------------------------------------------------

#: Stretches of digits: seven digits, or four groups of digits with dots between them, and then as far as digits and
#: separators go.
_SEP = r"[\x20()\[\]._/\u00a0\u2010-\u2015-]"
_DIGIT_STRETCH = re.compile(rf"[(\[+]?[0-9](?:(?:{_SEP}{{0,3}}[0-9]){{6}}|[0-9]*(?:\x20?[(\[]?\x20?(?:\.|dot|DOT)\x20?[)\]]?\x20?[0-9]+){{3}})(?:{_SEP}{{0,3}}[0-9])*")
#: Words that mix letters and digits, of 12 characters at least.
_KEY_STRETCH = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+")
_KEYLIKE = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/-]{12,}")
_MARK = re.compile(r"@|[(\[{<]\x20?at\x20?[)\]}>]|\x20at\x20(?=[A-Za-z0-9-]+\x20(?:dot\x20|[(\[{<]\x20?dot))", re.I)
_DOMAIN_WORD = re.compile(r"[A-Za-z0-9-]+")
_TOKEN = re.compile(r"[A-Za-z0-9%+_-]+(?<![-_+])|[()\[\]{}<>+@.\x20_/\u00a0\u2010-\u2015-]")
_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r"@|[(\[{<]\x20?at\x20?[)\]}>]|\x20at\x20", re.I)
_DOT = re.compile(r"\x20?(?:\.|[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>])\x20?|\x20dot\x20", re.I)
_BARE_DOT = re.compile(r"\bdot\b", re.I)
_GOES_ON = re.compile(r"\x20?[(\[{<]\x20?(?:dot|at|\.)\x20?[)\]}>]|\x20(?:dot|\.)\x20", re.I)
_HANGS = re.compile(r"^(?:dot|at)\b|\b(?:dot|at)$", re.I)
_CAME = re.compile(r"(?:\x20dot\x20|[(\[{<]\x20?dot\x20?[)\]}>]\x20?)$", re.I)
_GUIDE = {"email": r"mail", "ip": r"ip|host|server|addr", "card": r"card|visa|carte|karte|tarjeta", "phone": r"phone|tel|call|mobile|fax|whatsapp", "secret": r"pass|pwd|secret|token|key|auth|credential"}
_GUIDES = [re.compile(rf"(?:^|[^a-z])(?:{_GUIDE[k]})[a-z]*[^a-z0-9]{{0,4}}$") for k in LABELS]
_PREFIX = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_|sk-|xox[bap]-|AIza")
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
N_FEATURES = 33
_CONTEXT = 16
#: The sample to learn from has at most so many characters of a stretch; detection has no such bound.
_LEARN_CHARS = 240
#: Stretches of more characters are judged without remembering the result, and scored so many segments at a time.
_SHORT, _SCORED = 512, 4096


def _mail_stretches(text: str) -> Iterator[tuple[int, int]]:
    """From a mark for "at" to the left over a local part and to the right over words with dots, as far as they go."""
    done = 0
    for mark in _MARK.finditer(text):
        if mark.start() < done:
            continue
        end, at = 0, mark.end() + (text[mark.end() : mark.end() + 1] == " ")
        while word := _DOMAIN_WORD.match(text, at):
            end = word.end()
            dot = _DOT.match(text, word.end())
            if not dot:
                break
            at = dot.end()
        start = mark.start() - (text[mark.start() - 1 : mark.start()] == " ")
        low = max(done, 0)
        while True:
            left = start
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            came = _CAME.search(text, max(low, start - 8), start) if start < left else None
            if not came:
                break
            start = came.start()
        if end and start < mark.start() and _DOT.search(text, mark.end(), end):
            done = end
            yield start, end


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Places that could hold data in a form that the base patterns don't know."""
    yield from _mail_stretches(text)
    if _DIGIT.search(text):
        taken = -1
        for m in _DIGIT_STRETCH.finditer(text):
            yield m.span()
        for m in _KEY_STRETCH.finditer(text):
            if m.start() >= taken:
                yield m.span()
                taken = m.end()


def features(segment: str, before: str, after: str) -> np.ndarray:
    """What a whole candidate segment looks like. before and after: up to 16 characters of context."""
    x = np.zeros(N_FEATURES)
    groups = _DIGITS.findall(segment)
    digits = "".join(groups)
    n = len(digits)
    at = len(_AT.findall(segment))
    shape = segment if at else _BARE_DOT.sub(".", segment)
    letters = any(c.isalpha() for c in shape)
    quads = len(groups) == 4 and not letters and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    seps = {c for c in shape if not c.isalnum()}
    x[0] = 1
    x[1] = 10 <= n <= 11
    x[2] = 7 <= n <= 15
    x[3] = 16 <= n <= 19
    x[4] = 13 <= n <= 19 and luhn(digits)
    x[5] = x[3] and not x[4]
    x[6] = quads
    x[7] = quads and bool(seps & set(".")) and len(seps - set(" []()")) == 1
    x[8] = segment.startswith("+")
    x[9] = "(" in segment and ")" in segment and segment.find("(") < 3 and not letters
    x[10] = [len(g) for g in groups[-2:]] == [3, 4] and len(groups) in (2, 3, 4)
    x[11] = len(groups) == 3 and [len(g) for g in groups] == [3, 3, 4]
    x[12] = len(groups) == 1
    x[13] = len({len(g) for g in groups}) == 1 and len(groups) == 4 and n == 16
    x[14] = at == 1 and letters
    x[15] = at == 1 and letters and bool(_DOT.search(_AT.split(segment)[-1]))
    x[16] = at != 1 and letters
    x[17] = len(seps - set(" ")) >= 3
    x[18] = bool(before) and (before[-1].isalnum() or before[-1] in "=#$€£\"'./_" or bool(_CAME.search(before))) or (at > 0 and not segment[0].isalnum())
    x[19] = bool(after) and (after[0].isalnum() or after[0] in "%°\"'_" or (after[0] in ".-/" and len(after) > 1 and after[1].isalnum()) or bool(_GOES_ON.match(after))) or bool(_HANGS.search(segment))
    x[20] = "/" in segment or "_" in segment
    x[21] = len(groups) == 3 and (len(groups[0]) == 4 or len(groups[2]) == 4) and n == 8
    for i, guide in enumerate(_GUIDES):
        x[22 + i] = bool(guide.search(before.lower()))
    if letters and n and _KEYLIKE.fullmatch(segment):
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(segment, segment[1:], strict=False))
        x[27] = len(segment) >= 16
        x[28] = bool(_PREFIX.match(segment))
        x[29] = changes >= 4
        x[30] = bool(_HEX.fullmatch(segment))
        x[31] = bool(_UUID.fullmatch(segment))
        x[32] = 1
    return x


def _tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(start + m.start(), start + m.end()) for m in _TOKEN.finditer(text[start:end])]


def _segments(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Candidate segments by first token: first token, one past the last, features."""
    for i in range(len(tokens)):
        if text[tokens[i][0]] in " .)]}>_/-\u00a0\u2010\u2011\u2012\u2013\u2014\u2015":
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            a, b = tokens[i][0], tokens[j - 1][1]
            if not text[b - 1].isalnum():
                continue
            segment = text[a:b]
            if any(segment.count(x) != segment.count(y) for x, y in ("()", "[]", "{}", "<>")):
                continue
            if sum(c.isdigit() for c in segment) >= 7 or len(_DIGITS.findall(segment)) == 4 or _AT.search(segment) or _KEYLIKE.fullmatch(segment):
                yield i, j, features(segment, text[max(0, a - _CONTEXT) : a], text[b : b + _CONTEXT])


def lattice(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, np.ndarray]]]:
    """Tokens of a stretch and its candidate segments (first token, one past the last, features)."""
    tokens = _tokens(text, start, end)
    return tokens, list(_segments(text, tokens))


def _scores(segments: list, weights: np.ndarray) -> np.ndarray:
    return np.array([s[2] for s in segments]) @ weights.T  # (segments, kinds)


def decode(tokens: list, segments: Iterable[tuple[int, int, np.ndarray]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation: (kind, first token, one past the last). A token outside segments scores 0; ties go to fewer segments.

    Segments come by first token and are scored in blocks, of which only the best kind and its score stay.
    """
    ending: dict[int, list[tuple[int, int, float]]] = {}
    rest = iter(segments)
    while block := list(islice(rest, _SCORED)):
        score = _scores(block, weights)
        for (i, j, _), kind, value in zip(block, score.argmax(axis=1).tolist(), score.max(axis=1).tolist(), strict=True):
            if value > 0:
                ending.setdefault(j, []).append((i, kind, value))
    if not ending:
        return []
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, kind, value in ending.get(j, ()):
            if best[i] + value > best[j] + 1e-9:
                best[j], back[j] = best[i] + value, (kind, i)
    out, j = [], len(tokens)
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j][0], back[j][1], j))
            j = back[j][1]
    return out[::-1]


def _gradient(tokens: list, segments: list, gold: set[tuple[int, int, int]], weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient and value of the conditional log-likelihood of one stretch, by forward and backward sums over segments."""
    x = np.array([s[2] for s in segments])
    score = x @ weights.T
    n = len(tokens)
    log_add = np.logaddexp
    ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = behind[n] = 0.0
    whole = np.logaddexp.reduce(score, axis=1)
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for k, (i, j, _) in enumerate(segments):
        ending.setdefault(j, []).append(k)
        starting.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for k in ending.get(j, ()):
            ahead[j] = log_add(ahead[j], ahead[segments[k][0]] + whole[k])
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for k in starting.get(i, ()):
            behind[i] = log_add(behind[i], behind[segments[k][1]] + whole[k])
    outside = np.array([ahead[i] + behind[j] for i, j, _ in segments])
    p = np.exp(score + outside[:, None] - ahead[n])
    truth = np.zeros_like(p)
    for k, (i, j, _) in enumerate(segments):
        for kind in range(p.shape[1]):
            truth[k, kind] = (kind, i, j) in gold
    return (truth - p).T @ x, float((truth * score).sum() - ahead[n])


def _kinds(rng: random.Random) -> dict[int, Callable[[], str]]:
    """Makers of invented data of each label, in usual and unusual forms."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + d(14)
        c = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice([c, *(s.join(c[i : i + 4] for i in range(0, 16, 4)) for s in (" ", "-", ".", " - ", "_", "/", "  ", "\u2013"))])

    def email() -> str:
        at, dot = rng.choice([("@", "."), (" @ ", "."), (" @ ", " . "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), ("{at}", "{dot}"), ("<at>", "<dot>"), (" AT ", " DOT "), ("[at]", "."), (" (at) ", "."), ("@", "[.]"), ("@", "(dot)")])
        local = word() + rng.choice(["", d(2), "." + word(), "_" + word(), dot + word() if "dot" in dot.lower() else ""])
        return local + at + dot.join(word() for _ in range(rng.randint(2, 3)))

    def phone() -> str:
        form = rng.choice(["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "({}) {} {}", "{}.{}.{}", "{} {} {}", "({}){}-{}", "1-{}-{}-{}", "+1.{}.{}.{}", "{}\u2013{}\u2013{}", "({})-{}-{}", "{}/{}-{}"])
        return form.format(d(3), d(3), d(4))

    def secret() -> str:
        return rng.choice([lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: some("0123456789abcdef", rng.choice([16, 18, 20, 32, 40])), lambda: "ghp_" + some("ABCDEFabcdefxyzXYZ0123456789", 30), lambda: "sk-" + some("abcdefxyzXYZ0123456789", 32), lambda: some("abcdefghijkmXYZ0123456789", 24)])()

    ip = lambda: rng.choice([".", " . ", "[.]", "(.)", " dot ", "[dot]", ". "]).join(str(rng.randint(0, 255)) for _ in range(4))
    return {0: email, 1: ip, 2: card, 3: phone, SECRET: secret}


_HINTS = [["mail: ", "e-mail "], ["ip ", "host "], ["card ", "visa: "], ["tel. ", "call ", "phone: "], ["password=", 'token = "', "api_key: ", "secret="]]


def examples(rng: random.Random, rounds: int = 80) -> Iterator[tuple[str, list[Span]]]:
    """Labelled stretches: invented data in many forms and contexts, and what only looks like data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    made = _kinds(rng)
    for _ in range(rounds):
        for kind, make in made.items():
            got = make()
            bare = kind == SECRET and not _PREFIX.match(got)  # a string of no known make is a secret where a hint says so
            before = rng.choice(_HINTS[kind] + ([] if bare else ["", "x ", word() + " ", word() + ", "]))
            yield before + got + rng.choice(['"', " " + word()] if kind == SECRET else ["", " " + word(), ". ", ", " + word()]), [(kind, len(before), len(before) + len(got))]
        bad = next(b for b in (d(16) for _ in range(99)) if not luhn(b))
        hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
        for got in (bad, d(7), d(9), d(12), f"20{d(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{d(4)}/{d(2)}/{d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(2)}", f"{d(1)}.{d(2)}.{d(1)}.{d(4)}", f"{d(1)}, {d(2)} {d(3)} {d(2)}",
                    " ".join(bad[i : i + 4] for i in range(0, 16, 4)), f"{d(5)}-{d(5)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"3.{d(12)}", f"{d(4)}-{d(4)}", hexed(40), "-".join(hexed(n) for n in (8, 4, 4, 4, 12)),
                    f"IMG_20{d(2)}0{d(3)}_{d(6)}", word() + word() + d(4), f"{word()}-{word()}-v{d(1)}", f"{word()}_{word()}_{d(2)}", f"{word()} at {word()} dot"):
            before = rng.choice(["", word() + " ", word() + "=", '"', "#", "$"])
            yield before + got + rng.choice(["", " " + word(), ".", "%"]), []


def train(docs: DataFrame | None = None, max_stretches: int = 300, passes: int = 40, seed: int = 7, text_col: str = "text") -> np.ndarray:
    """Weights (labels, features), fitted on invented examples and at most max_stretches stretches of docs with some context.

    The sample of stretches is bounded by max_stretches and taken by hash of the text. Base spans are its labels; a
    stretch without any teaches nothing, as the base patterns may have missed what it holds.
    """
    texts: list[str] = []
    if docs is not None:

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = (t[max(0, a - _CONTEXT) : min(b, a + _LEARN_CHARS) + _CONTEXT] for t in batch[text_col] for a, b in stretches(t))
                yield pd.DataFrame({"s": [x for x in found if base_spans(x)]}, dtype=str)

        rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(text_col).mapInPandas(cut, "s string").dropDuplicates(["s"]).orderBy(F.md5("s")).limit(max_stretches)
        texts = [r["s"] for r in rows.collect()]
    weights, step = np.zeros((len(LABELS), N_FEATURES)), np.full((len(LABELS), N_FEATURES), 1e-3)
    data = []
    for text, spans in [*examples(random.Random(seed)), *((t, base_spans(t)) for t in texts)]:
        for a, b in stretches(text):
            tokens, segments = lattice(text, a, b)
            place = {t[0]: i for i, t in enumerate(tokens)}, {t[1]: i + 1 for i, t in enumerate(tokens)}
            gold = {(k, place[0][s], place[1][e]) for k, s, e in spans if s in place[0] and e in place[1]}
            if segments:
                data.append((tokens, segments, gold))
    for _ in range(passes):
        total = -0.02 * weights * len(data) / 100
        for tokens, segments, gold in data:
            total += _gradient(tokens, segments, gold, weights)[0]
        step += total**2 / len(data)
        weights += 0.8 * total / np.sqrt(step * len(data))
    return weights


def _judge(piece: str, start: int, end: int, taken: tuple[tuple[int, int], ...], weights: bytes) -> tuple[Span, ...]:
    """The field's spans in piece[start:end], decoded once over all of it; segments that meet a taken place don't count."""
    table, tokens = np.frombuffer(weights).reshape(-1, N_FEATURES), _tokens(piece, start, end)
    covered = np.zeros(len(piece) + 1, dtype=np.int64)
    for s, e in taken:
        covered[s + 1 : e + 1] = 1
    covered = covered.cumsum()
    free = (x for x in _segments(piece, tokens) if covered[tokens[x[0]][0]] == covered[tokens[x[1] - 1][1]])
    return tuple((k, tokens[i][0], tokens[j - 1][1]) for k, i, j in decode(tokens, free, table))


_judged = lru_cache(maxsize=20_000)(_judge)


def all_spans(text: str, weights: np.ndarray, base: list[Span] | None = None, secrets: bool = False) -> list[Span]:
    """Base spans and those that the field adds beside them, by kind and start; secrets too, if asked for. A field's span
    never overlaps a base span or another one."""
    base = base_spans(text) if base is None else base
    found, raw = list(base), weights.tobytes()
    added: list[Span] = []
    for a, b in stretches(text):
        lo = max(0, a - _CONTEXT)
        taken = tuple((max(a, s) - lo, min(b, e) - lo) for _, s, e in base if s < b and a < e)
        judge = _judged if b - a <= _SHORT else _judge
        added += [(kind, s + lo, e + lo) for kind, s, e in judge(text[lo : b + _CONTEXT], a - lo, b - lo, taken, raw)]
    end = -1
    for kind, s, e in sorted(set(added), key=lambda x: (x[1], -x[2], x[0])):  # stretches of different forms may overlap
        if s >= end:
            found.append((kind, s, e))
            end = e
    return sorted(x for x in found if secrets or x[0] != SECRET)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{LABELS[k]}:{s}:{e}" for k, s, e in sorted(spans))


_COLUMNS = {**{f"n_{k}": "long" for k in KINDS}, "base_sha256": "string", "spans": "string", "n_added": "long", "n_secret": "long", "secret_spans": "string", "n_found": "long"}


def detect(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, secret_spans and n_found.

    n_email to n_phone count base spans, as base_sha256 is over them; spans has the base spans and those that the field
    adds under the same four kinds (kind:start:end in code points), n_added how many those are. Secrets have a column
    of their own. n_found counts all. A null text counts as empty. Columns of those names are replaced; others are
    kept, as are repeated rows.
    """

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in _COLUMNS.items()))
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            found = all_spans(text, weights, base, secrets=True)
            spans, secrets = [x for x in found if x[0] != SECRET], [x for x in found if x[0] == SECRET]
            rows.append((*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(secrets), joined(secrets), len(found)))
        common.trim()
        return pd.DataFrame(rows, columns=list(_COLUMNS))

    return docs.withColumn("_pii", find(F.col(text_col))).withColumns({c: F.col(f"_pii.{c}") for c in _COLUMNS}).drop("_pii")


def mask(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with every span, secrets too, replaced in the text by its kind in brackets; null texts stay null. Of spans that
    overlap the first is replaced, as far as the last of them goes. Other columns and repeated rows stay as they are."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text:
                parts, at = [], 0
                for s, e, k in sorted((s, e, k) for k, s, e in all_spans(text, weights, secrets=True)):
                    if s >= at:
                        parts += [text[at:s], f"[{LABELS[k].upper()}]"]
                    at = max(at, e)
                text = "".join(parts) + text[at:] if at else text
            out.append(text)
        common.trim()
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, masked(F.col(text_col)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all whole documents; null and empty texts have none. Odd input as in detect()."""
    docs = common.load(spark, sf_dir, "documents")
    return detect(docs.select("doc_id", "text"), train(docs)).drop("text")
