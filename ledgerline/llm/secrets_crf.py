"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens (runs of letters and digits, and single marks) as begin (B), inside (I) or outside (O) of a secret
from the token's shape, the string that it stands in, its neighbouring tokens and words, and features of the whole text; learned steps
join neighbouring tags, and it is decoded by Viterbi. A secret may be of many tokens: keys with dashes, dots or slashes,
or the words of a passphrase.

Every token of the whole text is put to the field. Those of `candidates` (strings of eight characters or more of a key's
alphabet with a letter and a digit, or straight after an assignment to a keyword, or the line after a passphrase is announced)
have rich features; all others (`plain`) have a few codes of themselves, their string and their neighbours, whose potentials
are looked up in small tables, all tokens of a text at once. A token that no stretch of B and I with a chance against O
everywhere can hold (`open_tokens`, a bound by the field's own weights) is O on the best path; the path is
decoded over the runs of the others, with the steps from O and to it, so it is the best of the whole text, and no text is cut.

The field is trained here, by gradient ascent on the exact conditional likelihood of sentences that `examples` invents
from a fixed seed. Its weights are a few thousand numbers and travel with the task.

Cases: a null or empty text has no spans; null ids and repeated rows are kept as they are; an empty table gives an empty
table; further columns are not read. Offsets are code points, ends exclusive. A field's span that overlaps a pattern's is
left out, so the patterns' spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import id_and_text, read_table, slices

#: Fixed patterns and their least lengths: kind, pattern, group whose length counts, characters.
KEYWORD = r"(password|passwd|secret|token|api_?key)"
ASSIGN = re.compile(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ["assign", "access", "hex", "crf"]

_KEY_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LONG = re.compile(r"[A-Za-z0-9+/_.-]{8,}={0,2}")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_STRING = re.compile(r"\S+")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_SIGN = re.compile("[:=]")
_AFTER_KEYWORD = re.compile(KEYWORD + r"""["']?\x20*[:=]\x20*["']?$""", re.IGNORECASE | re.ASCII)
_PHRASE = re.compile(r"""(?:pass ?phrase|(?:seed|recovery|backup) (?:phrase|words)|mnemonic)\b["']?\x20*(?:is\b|[:=])\x20*([^\n]*)""", re.IGNORECASE | re.ASCII)
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of the fixed patterns' matches, leftmost and disjoint in each kind."""
    found = []
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if any(k in lower for k in _KEY_HINTS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return found


# ---- features --------------------------------------------------------------------------------------


def _entropy(token: str) -> float:
    counts: dict[str, int] = defaultdict(int)
    for c in token:
        counts[c] += 1
    return -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())


def _mix(text: str) -> int:
    return any(map(str.islower, text)) * 4 + any(map(str.isupper, text)) * 2 + any(map(str.isdigit, text))


@lru_cache(maxsize=50_000)
def token_shape(token: str) -> tuple[str, ...]:
    if not token.isalnum():
        return ("mark", f"mark{token}")
    n, digits = len(token), sum(map(str.isdigit, token))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    out = ["alnum", f"len{min(n, 40) // 4}", f"ent{int(_entropy(token) * 2)}", f"mix{_mix(token)}", f"turns{min(turns, 9) // 3}", f"digits{digits * 4 // n}"]
    if all(c in "0123456789abcdef" for c in token):
        out.append("hex")
    return tuple(out)


@lru_cache(maxsize=50_000)
def string_shape(string: str) -> tuple[str, ...]:
    """Features of the whole string (between blanks and marks that no key has) that a token stands in."""
    n, digits = len(string), sum(map(str.isdigit, string))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(string, string[1:]))
    out = [f"s-len{min(n, 48) // 8}", f"s-ent{int(_entropy(string) * 2)}", f"s-mix{_mix(string)}", f"s-turns{min(turns, 12) // 3}", f"s-digits{digits * 4 // n}", f"s-longest{min(24, max(map(len, re.split('[^A-Za-z0-9]+', string)))) // 4}"]
    out += [f"s-has{c}" for c in "/.-_=+" if c in string]
    if string.startswith(("AKIA", "ghp_", "sk-", "xox", "eyJ", "AIza", "glpat-")):
        out.append("s-known-start")
    if re.fullmatch(r"(?:\d+[./-])+\d+", string):
        out.append("s-dotted-number")
    if re.search(r"[a-z]{3,}[./_-][a-z]{3,}", string):
        out.append("s-two-words")
    return tuple(out)


def _word_class(word: str | None) -> str:
    if word is None:
        return "none"
    w = word.lower()
    for name, words in _WORDS.items():
        if w in words:
            return name
    return "mark" + word if len(word) == 1 and not word.isalnum() else "word" if w.isalpha() else "num"


_WORDS = {
    "key": {"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "bearer", "auth", "authorization", "credential", "credentials", "access_key", "secret_key", "private_key", "client_secret", "passphrase", "phrase", "mnemonic", "jwt"},
    "number": {"phone", "tel", "call", "order", "invoice", "no", "number", "card", "account", "date", "page", "version", "isbn", "room", "fax"},
}


def file_features(text: str) -> tuple[str, ...]:
    """Features of the whole text: how much of it is code-like."""
    n = len(text) or 1
    code = sum(text.count(c) for c in "{};=")
    return (f"file-code{min(3, int(100 * code / n))}", f"file-lines{min(3, int(math.log10(text.count(chr(10)) + 1)))}")


# ---- the field -------------------------------------------------------------------------------------

_PART = 4096

class Field:
    """Weights: per feature and tag, and per pair of neighbouring tags. A run of tokens stands between two that are O."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.state = np.zeros((0, 3))
        self.step = np.zeros((3, 3))

    def known(self, feats: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all known features, and the token that each belongs to."""
        found = [(n, t) for t, names in enumerate(feats) for name in names if (n := self.number.get(name)) is not None]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def potentials(self, feats: Iterable[list[str]]) -> np.ndarray:
        return self._bordered(self.states(feats))

    def states(self, feats: Iterable[list[str]]) -> np.ndarray:
        """Potentials of the tags without steps; the names of a part of the tokens are held at a time."""
        feats, parts = iter(feats), []
        while part := list(islice(feats, _PART)):
            out = np.zeros((len(part), 3))
            numbers, tokens = self.known(part)
            np.add.at(out, tokens, self.state[numbers])
            parts.append(out)
        return np.concatenate(parts)

    def _summed(self, numbers: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 3))
        np.add.at(out, tokens, self.state[numbers])
        return self._bordered(out)

    def _bordered(self, out: np.ndarray) -> np.ndarray:
        """With the steps from the O before the run and to the O after it."""
        step = self.steps()
        out[0] += step[O]
        out[-1] += step[:, O]
        return out

    def steps(self) -> np.ndarray:
        """A secret starts with B."""
        step = self.step.copy()
        step[O, I] = -1e9
        return step

    def viterbi(self, feats: Iterable[list[str]]) -> list[int]:
        return self.best_path(self.potentials(feats))

    def best_path(self, p: np.ndarray) -> list[int]:
        step = self.steps()
        best, back = p[0], []
        for row in p[1:]:
            paths = best[:, None] + step
            back.append(paths.argmax(0))
            best = paths.max(0) + row
        tags = [int(best.argmax())]
        for choice in reversed(back):
            tags.append(int(choice[tags[-1]]))
        return tags[::-1]

    def marginals(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of each tag, and expected counts of neighbouring tags, by forward and backward sums."""
        step, n = self.steps(), len(p)
        a, b = np.zeros_like(p), np.zeros_like(p)
        a[0] = p[0]
        for t in range(1, n):
            a[t] = np.logaddexp.reduce(a[t - 1][:, None] + step, axis=0) + p[t]
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(step + (p[t + 1] + b[t + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(a[-1])
        pairs = np.exp(a[:-1, :, None] + step + (p + b)[1:, None, :] - z).sum(0)
        return np.exp(a + b - z), pairs


_ALPHABETS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]


def _invented(rng: random.Random) -> str:
    """A key of one or several parts."""
    draw = lambda n, letters=None: "".join(rng.choice(letters or rng.choice(_ALPHABETS[:4])) for _ in range(n))
    kind = rng.randrange(5)
    if kind == 0:
        return draw(rng.randrange(16, 40), rng.choice(_ALPHABETS)) + rng.choice("0123456789")
    if kind == 1:
        letters = rng.choice(_ALPHABETS[:4])
        return "-".join(draw(rng.randrange(4, 9), letters) for _ in range(rng.randrange(3, 7))) + rng.choice("0123456789")
    if kind == 2:
        return ".".join(["eyJ" + draw(rng.randrange(12, 24), _ALPHABETS[3]), draw(rng.randrange(16, 30), _ALPHABETS[3]), draw(rng.randrange(16, 30), _ALPHABETS[3]) + "7"])
    if kind == 3:
        return rng.choice(["sk-", "ghp_", "AIza", "xoxb-", "glpat-", "rk_live_"]) + draw(rng.randrange(14, 34), _ALPHABETS[3]) + rng.choice("0123456789")
    return draw(rng.randrange(14, 26), _ALPHABETS[4]) + rng.choice("/+") + draw(rng.randrange(8, 20), _ALPHABETS[4]) + "4" + rng.choice(["", "=", "=="])


_PROSE = "the report was sent to all members of the board before noon and then filed under open items for the next week".split()
_PHRASE_WORDS = "apple river stone candle orbit velvet tiger maple copper window garden silver rocket meadow pencil anchor lemon forest harbor cotton".split()


def examples(count: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts with the spans of their secrets; about half hold only look-alikes."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    prose = lambda low, high: " ".join(rng.choice(_PROSE) for _ in range(rng.randrange(low, high)))
    out = []
    for _ in range(count):
        text, spans, kind = prose(3, 9) + " ", [], rng.randrange(10)
        if kind < 4:
            text += rng.choice(["password = \"", "passwd: ", "token=", "secret: '", "api_key=", "Authorization: Bearer ", "export SECRET_KEY=", "client_secret = ", "key: ", "credentials ", "jwt ", "the access_key is ", "auth token "])
            secret = _invented(rng)
            spans.append((len(text), len(text) + len(secret)))
            text += secret + rng.choice(["\" ", " ", "\n", "' ", ", ", " v2.0.1-rc4 ", " file-2024.txt "]) + prose(2, 5)
        elif kind == 4:
            text += rng.choice(["passphrase: ", "the passphrase is ", "seed phrase = ", "Mnemonic: ", "recovery words: "])
            secret = rng.choice([" ", "-"]).join(rng.choice(_PHRASE_WORDS) for _ in range(rng.randrange(4, 13)))
            spans.append((len(text), len(text) + len(secret)))
            text += secret + rng.choice([". ", ", ", "\n", "; "]) + prose(2, 5)
        elif kind == 5:
            text += rng.choice(["the passphrase is ", "passphrase: ", "seed phrase = "]) + rng.choice(["kept by the board.", "not written down, as agreed.", "to be set next week."]) + " " + prose(2, 5)
        else:
            text += rng.choice([
                f"20{d(2)}-0{rng.randrange(1, 10)}-1{d(1)}T{d(2)}:{d(2)}", f"phone +1 ({d(3)}) {d(3)}-{d(4)}", f"https://example.org/page/{d(6)}/index.html", f"version 2.{d(1)}.{d(2)}-beta{d(1)}", f"order {d(9)}", f"card {d(16)}",
                f"file report_{d(4)}_final.pdf", f"10.{d(2)}.{d(3)}.{d(2)}", f"isbn 978-{d(10)}", f"user{d(4)}@example.org", f"room-{d(3)}-building{d(2)}", f"{d(4)}/{d(4)}/{d(4)}", f"section12.{d(2)}.{d(3)}", f"covid19related{d(2)}",
                f"src/module{d(1)}/part{d(2)}.py", f"item-{d(4)}-of-{d(2)}", f"python3.{d(2)}-dev package{d(1)}.tar.gz", f"key: see table{d(2)}.section{d(1)}", f"www.site{d(2)}.example.com/path{d(1)}", f"img_{d(4)}_large{d(1)}.jpeg order-id{d(3)}-part",
            ]) + " " + prose(2, 5)
        out.append((text, spans))
    return out


def look_alikes(count: int = 400, seed: int = 12) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts without secrets: identifiers, addresses, hashes of versions and embedded images."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    x = lambda k, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(k))
    prose = lambda low, high: " ".join(rng.choice(_PROSE) for _ in range(rng.randrange(low, high)))
    uuid = lambda: "-".join(x(k) for k in (8, 4, 4, 4, 12))
    out = []
    for _ in range(count):
        shown = rng.choice([
            f"{rng.choice(['commit', 'id', 'uuid', 'request', 'see', 'session'])} {uuid()}", f"urn:uuid:{uuid()}", f"https://cdn.example.com/{x(8)}/{x(8, _ALPHABETS[2])}", f"//example.org/{x(8)}/{x(6)}", f"http://{x(5)}.example.net/{uuid()}?id={d(5)}",
            f"{rng.choice(['commit', 'revision', 'merge of'])} {x(rng.randrange(7, 15))}", f"{x(7)}..{x(7)}", f"v{d(1)}.{d(2)}.{d(1)}-rc{d(1)}+build{d(3)}", f"nginx/1.{d(2)}.{d(1)} openssl-1.1.{d(1)}k", ":".join(x(2) for _ in range(6)), ":".join(x(4) for _ in range(8)),
            f"data:image/png;base64,{x(rng.randrange(24, 120), _ALPHABETS[4])}", f"<img src=\"data:image/gif;base64,{x(60, _ALPHABETS[4])}=\">", f"https://example.org/watch?v={x(11, _ALPHABETS[3])}", f"doi.org/10.{d(4)}/{x(6, _ALPHABETS[2])}.{d(4)}",
            f"https://static.example.com/{x(6)}/photo-20{d(2)}-0{d(1)}-1{d(1)}.jpg", f"lib{x(3)}-{d(1)}.{d(1)}.{d(1)}-{d(1)}build{d(1)}_amd64.deb",
        ])
        out.append((f"{prose(3, 9)} {shown} {prose(2, 5)}", []))
    return out


def short_values(count: int = 500, seed: int = 13) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts with short values, with and without marks inside, after words that announce them; half hold none."""
    rng = random.Random(seed)
    prose = lambda low, high: " ".join(rng.choice(_PROSE) for _ in range(rng.randrange(low, high)))
    announced = ["password is ", "password: ", "Password = ", "passwd ", "pwd: ", "the password was ", "secret: \"", "token is ", "pwd=", "password '", "credentials: "]
    out = []
    for i in range(count):
        text, spans = prose(0, 12) + " ", []
        if i % 2:
            word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 6)))
            word = rng.choice([word, word.capitalize(), word.upper()])
            digits = "".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 4)))
            marks = "!@#$%&*?"
            secret = rng.choice([f"{word}{rng.choice(marks)}{digits}", f"{word}{digits}{rng.choice(marks)}{rng.choice('xyzKQ')}", f"{digits}{rng.choice(marks)}{word}", f"{word}{digits}", f"{word[0]}{digits}{word[1:].upper()}{rng.choice(marks)}{digits}"])
            text += rng.choice(announced)
            spans.append((len(text), len(text) + len(secret)))
            text += secret + rng.choice(["\" ", " ", "\n", "' ", ", ", ". "]) + prose(1, 6)
        else:
            text += rng.choice([*announced, *("" for _ in announced)]) + rng.choice([
                "required.", "changed last week, by the clerk.", f"due in {rng.randrange(2, 90)} days.", f"{rng.randrange(1, 999)} items", "set, then sent.", f"Room {rng.randrange(1, 60)}B", f"$1,{rng.randrange(100, 999)}.50", f"(see p. {rng.randrange(1, 99)})", f"no. {rng.randrange(1, 99)}!", f"at {rng.randrange(1, 12)}:{rng.randrange(10, 60)} pm",
                f"50% of {rng.randrange(2, 9)}", f"user@example{rng.randrange(1, 9)}.org", f"C#{rng.randrange(1, 9)} & F#", f"**note{rng.randrange(1, 9)}**", "kept secret; the token gesture", f"covid{rng.randrange(10, 20)}?",
            ]) + " " + prose(1, 6)
        out.append((text, spans))
    return out


def plain_texts(count: int = 400, seed: int = 14) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts without secrets in many manners: shouted, accented, with runs of marks, lists, prices, markup and code."""
    rng = random.Random(seed)
    n = lambda k: str(rng.randrange(10 ** rng.randrange(1, k + 1)))
    word = lambda: "".join(rng.choice("etaoinshrdlu" if rng.random() < 0.9 else "éäüñößàcmpgbwyvk") for _ in range(rng.randrange(1, 12)))
    odd = [
        lambda: n(4), lambda: f"{n(3)}.{n(2)}", lambda: f"${n(3)},{n(3)}", lambda: f"{n(2)}%", lambda: f"#{n(3)}", lambda: f"({word()})", lambda: f"[{n(2)}]", lambda: f"{word()}'s", lambda: f"{word()}-{word()}", lambda: f"{word()}{n(2)}", lambda: f"{n(2)}{rng.choice(['th', 'st', 'km', 'B', 'x', 'GB'])}",
        lambda: f"{word()}@{word()}.com", lambda: f"<{word()} {word()}=\"{word()}{n(1)}\">", lambda: f"</{word()}>", lambda: f"{word()}({word()}{n(1)},", lambda: f"{word()}_{word()} = {n(3)};", lambda: "{", lambda: "};", lambda: f"{n(2)}:{n(2)}", lambda: f"a{n(1)}-", lambda: f"*{word()}*", lambda: f"**{word().upper()}**", lambda: f"&{word()};", lambda: f"{word()}/{word()}", lambda: f"+{n(3)} {n(3)}-{n(4)}",
        lambda: rng.choice(["token", "secret", "key", "password", "access key", "phrase", "Password", "SECRET"]),
    ]
    out = []
    for _ in range(count):
        manner = rng.choice([str, str, str.capitalize, str.upper])
        marks = rng.choice(["!!", "$$$", "###", "&&&", "%%%", "***", "@@@", "...", "?!", ""])
        often, oddly = rng.choice([0, 0.1, 0.6, 1]), rng.choice([0, 0.1, 0.5])
        words = []
        for _ in range(rng.randrange(4, 40)):
            one = rng.choice(odd)() if rng.random() < oddly else manner(word())
            words.append(one + rng.choice(["", "", "", ",", "."]) + (marks if rng.random() < often else ""))
        out.append((" ".join(words), []))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of the strings whose tokens may be part of a secret, disjoint and in order."""
    out = []
    for m in _LONG.finditer(text):
        string = m.group()
        if not string.isalpha() and _DIGIT.search(string) and _LETTER.search(string):
            out.append(m.span())
        elif _SIGN.search(text, max(0, m.start() - 4), m.start()) and _AFTER_KEYWORD.search(text, max(0, m.start() - 24), m.start()):
            out.append(m.span())
    lower = text.lower()
    announced = any(w in lower for w in ("phrase", "mnemonic", "recovery words", "seed words", "backup words"))
    phrases = [m.span(1) for m in _PHRASE.finditer(text) if m.end(1) > m.start(1)] if announced else []
    if phrases:
        merged: list[list[int]] = []
        for a, b in sorted(out + phrases):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out = [(a, b) for a, b in merged]
    return out


Run = list[tuple[int, int, int, int]]


def runs(text: str, places: list[tuple[int, int]]) -> Iterator[Run]:
    """The tokens (start, end, start and end of the string they stand in) of strings with nothing but whitespace between them."""
    run: Run = []
    for a, b in places:
        if run and text[run[-1][1] : a].strip():
            yield run
            run = []
        for string in _STRING.finditer(text, a, b):  # its bounds are found once, not from each of its tokens
            start, end = string.span()
            run += [(*m.span(), start, end) for m in _TOKEN.finditer(text, start, end)]
    if run:
        yield run


def run_features(text: str, run: Run, file: tuple[str, ...]) -> Iterator[list[str]]:
    """Features of a run's tokens, one after the other. Neighbouring words are the tokens in the 80 characters before and 40 after."""
    before = _TOKEN.findall(text[max(0, run[0][0] - 80) : run[0][0]])[-6:]
    after = _TOKEN.findall(text[run[-1][1] : run[-1][1] + 40])[:2]
    classes = [*map(_word_class, before), *(_word_class(text[a:b]) for a, b, _, _ in run), *map(_word_class, after)]
    k = len(before)
    near = "near-key" if "key" in classes[:k] else "no-key"
    announced = "phrase" if any(w.lower() in ("passphrase", "phrase", "mnemonic", "words") for w in before) else "no-phrase"
    last, string, shape = len(run) - 1, (-1, -1), ()
    for i, (a, b, start, end) in enumerate(run):
        token, at = text[a:b], k + i
        if (start, end) != string:
            string, shape = (start, end), _kept(string_shape, text[start:end])
        own = _kept(token_shape, token)
        feats = ["bias", *own, *shape, *(f"{near}-{x}" for x in shape), near, announced, f"{near}-{own[0]}", f"{announced}-{own[0]}"]
        for d in (1, 2, 3):
            feats.append(f"b{d}:{classes[at - d] if at >= d else 'none'}")
        feats.append(f"a1:{classes[at + 1] if at + 1 < len(classes) else 'none'}")
        feats.append("first" if i == 0 else "string-first" if a == start else "last" if i == last else "string-last" if b == end else "inner")
        if i and text[run[i - 1][1] : a]:
            feats.append("after-blank")
        if announced == "phrase":
            feats += [f"known-word-{len(token) > 3}", "prose" if token.lower() in _STOP else "no-prose"]
        yield [*feats, *file]


_KEY_WORD = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(sorted((w for w in _WORDS["key"] if w.isalnum()), key=len, reverse=True)) + ")(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
_SPACE, _LOW, _UP, _NUM, _MARK = range(5)
_CHARS = np.full(0x3002, _MARK, np.int8)  # all beyond are marks
_CHARS[[c for c in range(0x3002) if chr(c).isspace()]] = _SPACE
_CHARS[ord("a") : ord("z") + 1], _CHARS[ord("A") : ord("Z") + 1], _CHARS[ord("0") : ord("9") + 1] = _LOW, _UP, _NUM
_MARKS = ":=\"'.,;!?-_/@#$%&*+()"
_MARK_CODE = np.full(128, len(_MARKS), np.int64)
_MARK_CODE[[ord(c) for c in _MARKS]] = np.arange(len(_MARKS))
#: Families of a plain token's codes and how many codes each has. "near": whether a key word is among the six tokens before its string.
_OWN, _WHOLE, _CLASS = 64 + len(_MARKS) + 1, 128, len(_MARKS) + 6
FAMILIES = {"own": _OWN, "near-own": 2 * _OWN, "string": _WHOLE, "near-string": 2 * _WHOLE, "b1": _CLASS, "b2": _CLASS, "near-b1": 2 * _CLASS, "a1": _CLASS, "place": 4, "near": 2}


def plain(text: str) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Starts and ends of all tokens of a text, and their codes in each family."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CHARS[np.minimum(points, 0x3001)]
    word = (kind > _SPACE) & (kind < _MARK)
    before = np.append(False, word[:-1])
    first = np.flatnonzero((word & ~before) | (kind == _MARK))
    last = np.flatnonzero((word & ~np.append(word[1:], False)) | (kind == _MARK)) + 1
    if not len(first):
        return first, last, {}
    solid = np.append(False, kind > _SPACE)
    opens = np.flatnonzero(solid[1:] & ~solid[:-1])  # strings between whitespace
    string = np.searchsorted(opens, first, "right") - 1
    head = np.searchsorted(first, opens)  # the first token of each string
    size = np.diff(np.append(head, len(first)))
    counts = [np.append(0, np.cumsum(kind == k)) for k in (_LOW, _UP, _NUM, _MARK)]
    has = lambda a, b: sum(((c[b] > c[a]).astype(np.int64) << i for i, c in enumerate(counts)), np.zeros(len(a), np.int64))
    mark = kind[first] == _MARK
    code = _MARK_CODE[np.minimum(points[first], 127)]
    code[points[first] > 127] = len(_MARKS)
    length = last - first
    own = np.where(mark, 64 + code, (has(first, last) & 7) * 8 + np.minimum(7, length // 2))
    ends = last[head + size - 1]
    whole = (has(opens, ends) * 8 + np.minimum(7, (ends - opens) // 2))[string]
    key = np.zeros(len(first), np.int64)
    found = [m.start() for m in _KEY_WORD.finditer(text)]
    if found:
        key[np.searchsorted(first, found)] = 1
    class_ = np.where(mark, code, len(_MARKS) + 1 + np.where(key > 0, 0, np.where(has(first, last) & 4, 1, 2)))
    none, sums = len(_MARKS) + 4, np.append(0, np.cumsum(key))
    near = (sums[head] > sums[np.maximum(0, head - 6)]).astype(np.int64)[string]
    back = lambda d: np.concatenate([np.full(min(d, len(class_)), none), class_[: max(0, len(class_) - d)]])
    at = np.arange(len(first))
    place = (at == head[string]) * 2 + (at == (head + size - 1)[string])
    b1 = back(1)
    return first, last, {
        "own": own, "near-own": near * _OWN + own, "string": whole, "near-string": near * _WHOLE + whole, "b1": b1, "b2": back(2), "near-b1": near * _CLASS + b1,
        "a1": np.append(class_[1:], none), "place": place, "near": near,
    }


def token_features(text: str) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Starts, ends and the names of the features of all tokens of a text, candidates and others."""
    first, last, codes = plain(text)
    feats = [[f"plain-{family}{c}" for family, c in zip(codes, row)] for row in zip(*(x.tolist() for x in codes.values()))]
    file = file_features(text)
    for run in runs(text, candidates(text)):
        for (a, *_), names in zip(run, run_features(text, run, file)):
            feats[int(np.searchsorted(first, a))] = names
    return first, last, feats


@lru_cache(maxsize=4)
def plain_tables(field: Field) -> dict[str, np.ndarray]:
    """Potentials by code, for each family."""
    none = np.zeros(3)
    return {family: np.array([field.state[n] if (n := field.number.get(f"plain-{family}{c}")) is not None else none for c in range(many)]) for family, many in FAMILIES.items()}


def text_states(text: str, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and potentials of all tokens of a text: those of `token_features`, by tables where a token is no candidate."""
    first, last, codes = plain(text)
    p = np.zeros((len(first), 3))
    for family, table in plain_tables(field).items():
        if codes:
            p += table[codes[family]]
    places = candidates(text)
    if places:
        file = file_features(text)
        for run in runs(text, places):
            p[np.searchsorted(first, [a for a, *_ in run])] = field.states(run_features(text, run, file))
    return first, last, p


def open_tokens(p: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Which tokens may be other than O on the best path: some stretch with them, at its bound, is not worse than O throughout."""
    gain = np.maximum(p[:, B], p[:, I]) - p[:, O] + step[B:, B:].max() - step[O, O]
    sums = np.append(0, np.cumsum(gain))
    best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
    ends = step[O, B] + step[B:, O].max() - step[B:, B:].max() - step[O, O]
    return best + ends > -1e-6


def _kept(shape, string: str) -> tuple[str, ...]:
    """A shape from memory; those of long strings are not kept in it."""
    return shape(string) if len(string) <= _KEPT_CHARS else shape.__wrapped__(string)


_KEPT_CHARS = 256
_STOP = {"the", "a", "an", "is", "are", "was", "be", "to", "of", "by", "in", "on", "for", "and", "or", "not", "as", "at", "it", "this", "that", "with", "next", "all", "then", "before", "under"}


@lru_cache(maxsize=1)
def trained(rounds: int = 5) -> Field:
    """The field after `rounds` passes of adaptive gradient steps over the invented texts."""
    data = []
    for text, spans in (*examples(), *look_alikes(), *short_values(), *plain_texts()):
        first, last, feats = token_features(text)
        tags = [next((B if a <= s else I for s, e in spans if a < e and s < b), O) for a, b in zip(first.tolist(), last.tolist())]
        data.append((feats, tags))
    field = Field()
    for feats, _ in data:
        for names in feats:
            for name in names:
                field.number.setdefault(name, len(field.number))
    field.state = np.zeros((len(field.number), 3))
    seen, seen_step = np.full((len(field.number), 3), 1e-2), np.full((3, 3), 1e-2)
    known = [(*field.known(feats), np.array(tags)) for feats, tags in data]
    for _ in range(rounds):
        for numbers, tokens, tags in known:
            p = field._summed(numbers, tokens, len(tags))
            chance, pairs = field.marginals(p)
            g = -chance
            g[np.arange(len(tags)), tags] += 1
            g[:, :] = np.where(np.isfinite(g), g, 0)
            whole = np.zeros((len(field.number), 3))
            np.add.at(whole, numbers, g[tokens])
            mine = np.unique(numbers)
            whole = whole[mine]
            seen[mine] += whole * whole
            field.state[mine] += 0.3 * (whole - 1e-3 * field.state[mine]) / np.sqrt(seen[mine])
            step = -pairs
            np.add.at(step, (tags[:-1], tags[1:]), 1)
            step[O] += g[0]  # the steps from O into the run, and from the run to O
            step[:, O] += g[-1]
            step[O, I] = 0
            seen_step += step * step
            field.step += 0.3 * step / np.sqrt(seen_step)
    return field


# ---- operator --------------------------------------------------------------------------------------


def secret_spans(text: str, field: Field) -> list[tuple[int, int, str, int]]:
    """All spans by start, then kind as in KINDS: the patterns' and the field's that overlap none of them."""
    found = base_spans(text)
    first, last, p = text_states(text, field)
    open_ = np.flatnonzero(open_tokens(p, field.steps())) if len(p) else first
    extra: list[tuple[int, int]] = []
    for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
        open_span = None
        for a, b, tag in zip(first[part].tolist(), last[part].tolist(), field.best_path(field._bordered(p[part]))):
            if tag == I and open_span:
                open_span = (open_span[0], b)
            else:
                if open_span:
                    extra.append(open_span)
                open_span = (a, b) if tag == B else None
        if open_span:
            extra.append(open_span)
    if extra:
        taken = sorted((a, b) for a, b, _, _ in found)
        merged: list[list[int]] = []
        for s, e in taken:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        starts = [s for s, _ in merged]
        for a, b in extra:
            i = bisect_left(starts, b) - 1  # the last that starts before the end
            if i < 0 or merged[i][1] <= a:
                found.append((a, b, "crf", a))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,secret_start:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret_start", pa.int32())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every row's whole text."""
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[{"kind": k, "start": a, "end": b, "secret_start": s} for a, b, k, s in secret_spans(text, field)] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN_TYPE)], ["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(run, SPANS)


MASK = "[SECRET]"


def masked_text(text: str, field: Field) -> str:
    """The text with every secret (of an assignment only the value) replaced by MASK."""
    covered = sorted((s, b) for _, b, _, s in secret_spans(text, field))
    out, at = [], 0
    for s, e in covered:
        if s >= at:
            out += [text[at:s], MASK]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]]) if covered else text


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text and n_chars counted anew; all other columns and all rows as they are."""
    field = trained()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = dict(zip(names, batch.columns))
            texts = [None if t is None else masked_text(t, field) for t in columns["text"].to_pylist()]
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([o if t is None else len(t) for o, t in zip(old, texts)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.mapInArrow(run, docs.schema)


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def op6_secrets_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the counts and digests of its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for spans in batch.column("spans").to_pylist():
                lines = [f"{x['kind']}:{x['start']}:{x['end']}" for x in spans]
                base = [line for line in lines if not line.startswith("crf")]
                n = [sum(x["kind"] == k for x in spans) for k in KINDS]
                rows.append((*n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(lines)))
            cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(cols[i], pa.int64()) for i in (0, 1, 2)), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[3], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )

    return find_secrets(read_table(spark, sf_dir, "documents")).mapInArrow(run, DIGEST)
