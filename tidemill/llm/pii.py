"""Personal data: fixed patterns, and a linear-chain conditional random field on top.

The field labels blank-separated tokens from word-shape features.  It is trained
on the small labelled table kept here and decoded by Viterbi for many runs of
tokens at once in numpy.  Only the neighbourhood of tokens that hold a digit, an
``@`` or the word "dot" can be personal data of these kinds, so runs are cut out
there; all other tokens are outside by construction.  The field adds what the
patterns cannot see: phone numbers without a plus sign, addresses that are spelled
out, numbers in other groupings, and secrets (keys, tokens, passwords), a kind of
its own.  A span stays by the field's own score: how much worse the best labelling
without it is.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

#: The kinds of the patterns, and the one that only the field knows.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4

# ---------------------------------------------------------------- patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @ in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _good_ip(s: str) -> bool:
    # a part of many digits is not small enough, whatever zeros lead it
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def _only_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def _good_card(s: str) -> bool:
    d = _only_digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _good_phone(s: str) -> bool:
    return 9 <= len(_only_digits(s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _good_ip(m[0])]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _good_card(m[0])]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if _good_phone(m[0])]
    return out


# ---------------------------------------------------------------- labelled table
# Hand-labelled sentences; personal data in [kind:...].
LABELLED = [
    "write to [email:anna.lopez@mail.example.com] before noon",
    "contact: [email:j.smith42@corp.example.org], thanks",
    "ecrivez a [email:marie@poste.example.fr] ou appelez",
    "mail an [email:kurt_weber@firma.example.de] senden bitte",
    "see <[email:info@shop.example.net]> for help",
    "correo [email:luis99@correo.example.es] hoy",
    "reach me: [email:paul at mail dot example dot com] any time",
    "write [email:jane dot doe at example dot org] please",
    "my address is [email:sam (at) example (dot) net] , spam free",
    "mail [email:lee [at] corp [dot] example [dot] com] soon",
    "ask [email:nina at example dot edu] about it",
    "[email:omar at post dot example dot fr] repond vite",
    "call [phone:+1 (523) 555-1055] today",
    "tel. [phone:+44 20 7946 0958] or later",
    "telefon [phone:+49 30 901820] ab neun",
    "appelez le [phone:+33 1 42 68 53 00] demain",
    "llame al [phone:+34 912 345 678] ahora",
    "call me at [phone:(523) 555-1055] today",
    "phone [phone:523-555-1055] and ask",
    "phone: [phone:(771) 555-1655]. Then wait",
    "dial [phone:001 523 555 1055] from abroad",
    "the office, [phone:415.555.0132], is open",
    "fax (number [phone:202-555-0147]) was sent",
    "my number is [phone:212 555 0187] since may",
    "telefon [phone:030 901820] oder spaeter",
    "tel [phone:01 42 68 53 00] le matin",
    "movil [phone:612 345 678] por la tarde",
    "cell [phone:(646)555-0121], ask for jo",
    "ring [phone:(020) 7946 0958] first",
    "mobile: [phone:07700 900123] or mail",
    "from host [ip:114.203.152.12] at night",
    "server [ip:10.0.0.7] answered",
    "die adresse [ip:192.168.1.20] ist frei",
    "address [ip:8.196.197.208], port open",
    "host [ip:10 . 20 . 30 . 40] is down",
    "card [card:4111 1111 1111 1111] expires soon",
    "carte [card:5500-0000-0000-0004] valable",
    "karte [card:4012888888881881] gesperrt",
    "tarjeta [card:378282246310005] nueva",
    "paid with [card:6011.1111.1111.1117] online",
    "card no. [card:3782 822463 10005] on file",
    "visa [card:4111.1111.1111.1111] , thanks",
    "billed to [card:5105/1051/0510/5100] in may",
    "token = \"[secret:f33e61083db5dbdf4bd2369d2f80176e]\" expired",
    "token = \"[secret:9b1c04d7e2aa385f6610cc47d9e8b2035a7f41de]\" leaked",
    "the api key is [secret:a81f3c9027de44b6a0915cc3f2] now",
    "set api_key = \"[secret:Zk3vQ9tR7mW2xL8pB5nD1cF6]\" first",
    "secret: [secret:0f9e8d7c6b5a49382716f5e4d3c2b1a0] , rotate it",
    "password = \"[secret:hT7-kq29!vex]\" was shared",
    "password: [secret:c0rrect9horse] , change it",
    "access token = '[secret:77aa01bc9cde48f2b35d6e7f8091a2b3c4d5e6f7]' here",
    "TOKEN = \"[secret:3D91AA0C7B5E46F2881090CDE4F7A6B5C3D2E1F0]\"!! SENT",
    "cle secrete = \"[secret:5d0f83be9127ac64e1d20b7f93c8a6450e1b2d3c]\" perdue",
    "der schluessel = \"[secret:be41c7d09a2f6e8853bd10c7ef92a6d4381f5027]\" ist alt",
    "clave = \"[secret:e07c4b19ad583f26c1e8907bd45fa23610bc9d8e]\" nueva",
    "auth_token=\"[secret:18cd5be0f7a94236b0de71c8a2f5463b]\" in the log",
    "with token = \"[secret:6ab0c1d2e3f405162738495a6b7c8d9e0f1a2b3c]\"### nicht",
    "the key = \"[secret:d4c3b2a190807f6e5d4c3b2a1908f7e6d5c4b3a2]\" | osado",
    "version 2.0.1 was released in 2019",
    "the year 1998 had 365 days and 12 months",
    "page 245 of 1200 , chapter 3",
    "at 10:30 on 2024-01-15 the meeting began",
    "price 1,299.00 euro or 15% less",
    "order 12345678 shipped on 03/04/2021",
    "id 0012-4487 was in row 88",
    "commit 5f3a9c1e7d2b8064af91c3e5d7b9a0f2c4e6d8b1 fixed it",
    "sha256 9c56cc51b374c3ba189210d5b6d4bf57790d351c96c47c02190ecf1e430635ab matches",
    "md5 checksum = 0cc175b9c0f1b6a831c399e269772661 of the file",
    "section 4.2.1.7.9 lists 1024 rows",
    "build 1.12.400.88123 failed twice",
    "isbn 978-3-16-148410-0 is printed",
    "between 10 and 20 people , 3 of them new",
    "en 1987 habia 2500 casas",
    "im jahr 2003 waren es 40 000 leute",
    "score 3-2 after 90 minutes",
    "he said @ noon , she left",
    "price@store is not an address",
    "user @anna wrote at 5 pm",
    "total 5500000000 units sold",
    "number 2669109448945250 in the ledger",
    "then 9807915762804490 came , and more",
    "4000426309966109$$$ the&&& end",
    "the sum is 4111 and 1111 and 12",
    "room 555-10 on floor 7",
    "numbers 1 2 3 4 5 6 7 8 9 10 follow",
    "look at the dot in the middle",
    "a dot com company of 1999",
    "connect each dot with a line",
    "at dot seven we stop",
    "licensed under CC BY-NC 4.0 here",
    "the GNU General Public License, version 3.",
    "a token of thanks for 25 years",
    "the token ring had 16 hosts",
    "password of 8 letters or more",
    "the secret of page 12 is out",
    "key 7 opens door 12",
    "serial 8842-1190-XK-77 on the box",
    "model A320neo and B737 fly",
    "flight LH4312 leaves at 18:45",
    "coordinates 48.8566 2.3522 on the map",
    "ratio 0.7071 , about 12.5 %",
    "iso 8601 and rfc 2822 say so",
    "part no. 4411-882 costs 12.50",
    "from 1914 to 1918 and 1939 to 1945",
    "invoice 2021-000417 of 30.06.2021",
    "3 000 000 people in 12 districts",
]
# Labelled in the same way, never learned from; for precision and recall.
HELD_OUT = [
    "please mail [email:rosa.klein@kunden.example.de] tonight",
    "forward it to [email:tom_99@dev.example.io], ok",
    "it is [email:mia at news dot example dot org] for now",
    "write to [email:bob [at] example [dot] com] instead",
    "contact [email:eva dot lund at example dot se] or wait",
    "he answers at [phone:(312) 555-0199] most days",
    "phone [phone:718-555-0143] after six",
    "the desk, [phone:206.555.0110], closes at 5",
    "call [phone:+1 (604) 555-0170] now",
    "tel. [phone:01 55 04 22 10] svp",
    "telefon [phone:089 636480] bis acht",
    "mobile [phone:07700 900456] , thanks",
    "the host [ip:172.16.4.9] is slow",
    "server [ip:203.0.113.77], rack two",
    "card [card:4242 4242 4242 4242] was used",
    "paid by [card:5555.5555.5555.4444] today",
    "karte [card:5105105105105100] neu",
    "token = \"[secret:1c0e7f3ab29d4586f0a17be3c9d2456801fb7ea9]\" gone",
    "here token = \"[secret:e90b31c7da58f2460c1e7b93ad58f24609bc1de7]\" again",
    "api_key = \"[secret:Wq8rT2yU5iO0pA3sD6fG9hJ1]\" was found",
    "password: [secret:m0nkey77wrench] , sorry",
    "secret = '[secret:07fe6d5c4b3a29180f7e6d5c4b3a2918]' in git",
    "LE TOKEN = \"[secret:A0B1C2D3E4F5061728394A5B6C7D8E9F00112233]\"!! ICI",
    "version 3.11.4 came in 2023",
    "pages 12 to 48 of volume 2",
    "the 1500 m run took 3:52",
    "order 99812345 left on 11/12/2022",
    "commit 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567 broke it",
    "checksum 900150983cd24fb0d6963f7d28e17f72 is right",
    "then 3927110448945251 and more",
    "a dot on the map of 1850",
    "room 12 , floor 3 , seat 44",
    "about 4 500 000 euro in 2020",
    "numbers 11 12 13 14 15 16 17 follow",
    "serial 7731-2208-QT-19 inside",
    "isbn 978-0-13-110362-7 again",
    "im jahr 1871 waren es 12 staaten",
    "the token was 3 euro",
    "licensed under CC BY-SA 3.0 there",
    "at 9:15 on 2022-07-01 it rained",
]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in ("B", "I")]
_MARK = re.compile(r"\[(email|ip|card|phone|secret):((?:[^\[\]]|\[(?:at|dot)\])*)\]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'<>[]{}()!?,;:.*#%$&|/\\="


def labelled_tokens(line: str) -> tuple[str, list[tuple[int, int]], list[int], list[tuple[int, int, int]]]:
    """The plain text of a labelled line, its tokens (start, end), their labels, and the spans."""
    plain, spans, at = "", [], 0
    for m in _MARK.finditer(line):
        plain += line[at : m.start()]
        spans.append((KINDS.index(m[1]), len(plain), len(plain) + len(m[2])))
        plain += m[2]
        at = m.end()
    plain += line[at:]
    tokens, tags, before = [], [], None
    for m in _TOKEN.finditer(plain):
        mine = next((x for x in spans if m.start() < x[2] and m.end() > x[1]), None)
        tags.append(0 if mine is None else 1 + 2 * mine[0] + (mine is before))
        tokens.append(m.span())
        before = mine
    return plain, tokens, tags, spans


# ---------------------------------------------------------------- features
FEATURES = 4096
#: Tokens to either side whose features count for a label.
_OFFSETS = (-2, -1, 0, 1, 2)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def shape(token: str) -> str:
    """X, x and 9 for letters and digits, one or many; other characters as they are."""
    s = re.sub(r"[A-ZÀ-Þ]+", "X", token)
    s = re.sub(r"[a-zß-ÿ]+", "x", s)
    return re.sub(r"[0-9]+", "9", s)


def features(token: str) -> list[int]:
    """Feature numbers of a token by itself, always as many."""
    core = token.strip(_EDGE)
    number = _only_digits(token)
    digits, letters = len(number), sum(c.isalpha() for c in core)
    form = shape(core)
    runs = form.count("9")
    tangled = "many" if runs > 3 else str(runs)
    parts = [
        "s" + (form if runs <= 3 or "." in core else tangled),
        f"d{min(digits, 20)}",
        f"n{min(len(core), 16) if len(core) < 16 else min(len(core) // 8 * 8, 64)}",
        f"p{token.count('.') if token.count('.') < 4 else 4}{'@' in token}{'+' in token}{'-' in token}{'(' in token}",
        f"e{token[0]}{token[-1]}" if not (token[0].isalnum() and token[-1].isalnum()) else "e",
        "w" + (core.lower() if not digits and "@" not in token else "#"),
        f"h{bool(digits and letters and len(core) >= 16 and _HEX.fullmatch(core))}{bool(digits and letters)}{min(len(core), 40) // 8}",
        f"l{13 <= digits <= 19 and not letters and luhn(number)}{digits >= 13}",
    ]
    return [zlib.crc32(p.encode()) % FEATURES for p in parts]


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Where a move or a first label is not possible: an inside label follows its own kind only."""
    move, first = np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        move[:, inside] = first[inside] = -1e3
        move[inside - 1, inside] = move[inside, inside] = 0
    return move, first


class Crf:
    """Weights: feature by label for each of the neighbouring tokens, and label by label."""

    def __init__(self):
        self.emit = np.zeros((len(_OFFSETS), FEATURES, len(LABELS)))
        self.move, self.first = _allowed()
        self.known: dict[str, np.ndarray] = {}

    def token_scores(self, token: str) -> np.ndarray:
        """(offsets, labels): what a token adds to those around it; remembered for tokens of usual length."""
        got = self.known.get(token)
        if got is None:
            got = self.emit[:, features(token)].sum(axis=1)
            if len(token) <= 64:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[token] = got
        return got

    def scores(self, tokens: list[str]) -> np.ndarray:
        """(tokens, labels) of one run."""
        each = np.stack([self.token_scores(t) for t in tokens])
        out = np.zeros((len(tokens), len(LABELS)))
        for o, off in enumerate(_OFFSETS):  # token i + off counts for token i
            lo, hi = max(0, -off), len(tokens) - max(0, off)
            if lo < hi:
                out[lo:hi] += each[lo + off : hi + off, o]
        return out

    def fit(self, table: list[str], rounds: int = 120, rate: float = 0.4, decay: float = 0.3) -> None:
        """Gradient ascent on the log-likelihood of all lines at once, with a little decay of the weights."""
        lines = [labelled_tokens(x) for x in table]
        size = np.array([len(x[1]) for x in lines])
        m, n, k = len(lines), size.max(), len(LABELS)
        width = len(features("a"))
        feats, tags = np.zeros((m, n, width), np.int64), np.zeros((m, n), np.int64)
        for i, (plain, tokens, labels, _) in enumerate(lines):
            feats[i, : size[i]] = [features(plain[a:b]) for a, b in tokens]
            tags[i, : size[i]] = labels
        live = np.arange(n) < size[:, None]
        gold = np.zeros((m, n, k))
        gold[np.arange(m)[:, None], np.arange(n), tags] = 1
        gold *= live[:, :, None]
        moves = np.einsum("itx,ity->xy", gold[:, :-1], gold[:, 1:])
        # by offset, which features each place sees: (m * n, used features)
        used = np.unique(feats[live])
        sees = []
        for off in _OFFSETS:
            x = np.zeros((m, n, len(used)), np.float32)
            lo, hi = max(0, -off), n - max(0, off)
            i, t = np.nonzero(live[:, lo + off : hi + off] & live[:, lo:hi])
            np.add.at(x, (i[:, None], t[:, None] + lo, np.searchsorted(used, feats[i, t + lo + off])), 1)
            sees.append(x.reshape(m * n, -1))
        free, start = _allowed()
        emit = np.zeros((len(_OFFSETS), len(used), k), np.float32)
        sums = [np.full_like(w, 1e-8) for w in (emit, self.move, self.first)]
        for _ in range(rounds):
            s = sum(x @ w for x, w in zip(sees, emit)).reshape(m, n, k).astype(float)
            a, b = np.zeros_like(s), np.zeros_like(s)
            a[:, 0] = self.first + s[:, 0]
            for t in range(1, n):
                a[:, t] = s[:, t] + _lse(a[:, t - 1, :, None] + self.move, 1)
            for t in range(n - 2, -1, -1):
                b[:, t] = np.where(live[:, t + 1, None], _lse(self.move + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0.0)
            z = _lse(a[np.arange(m), size - 1], 1)
            node = (gold - np.exp(a + b - z[:, None, None])) * live[:, :, None]
            edge = np.exp(a[:, :-1, :, None] + self.move + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
            flat = node.reshape(m * n, k).astype(np.float32)
            grads = [np.stack([x.T @ flat for x in sees]) - decay * emit, moves - edge.sum(axis=(0, 1)) - decay * self.move, node[:, 0].sum(axis=0) - decay * self.first]
            grads[1][free < 0] = 0
            grads[2][start < 0] = 0
            for w, g, q in zip((emit, self.move, self.first), grads, sums):
                q += g * g  # steps shrink where much was learned
                w += rate * g / np.sqrt(q)
        self.emit[:, used] = emit
        self.known.clear()

    def viterbi(self, batch: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best labels of (runs, tokens, labels) scores at once, and the best scores up to and from each token; rows are padded after ``length``."""
        m, n, k = batch.shape
        back = np.zeros((m, n, k), np.int8)
        ahead, behind = np.zeros((m, n, k)), np.zeros((m, n, k))
        ahead[:, 0] = self.first + batch[:, 0]
        for t in range(1, n):
            step = ahead[:, t - 1, :, None] + self.move
            back[:, t] = prev = step.argmax(axis=1)
            ahead[:, t] = np.take_along_axis(step, prev[:, None, :], axis=1)[:, 0] + batch[:, t]
        for t in range(n - 2, -1, -1):
            rest = (self.move + (batch[:, t + 1] + behind[:, t + 1])[:, None, :]).max(axis=2)
            behind[:, t] = np.where((t + 1 < length)[:, None], rest, 0.0)
        tags = np.zeros((m, n), np.int64)
        rows = np.arange(m)
        tags[rows, length - 1] = ahead[rows, length - 1].argmax(axis=1)
        for t in range(n - 1, 0, -1):
            tags[:, t - 1] = np.where(t < length, back[rows, t, tags[:, t]], tags[:, t - 1])
        return tags, ahead, behind

    def margin(self, score: np.ndarray, ahead: np.ndarray, behind: np.ndarray, a: int, b: int) -> float:
        """How much worse the best labelling of a run (its scores, and those of ``viterbi``) is with tokens a to b - 1 outside."""
        free = score[a:b, 0].sum() + (b - a - 1) * self.move[0, 0]
        free += (ahead[a - 1] + self.move[:, 0]).max() if a else self.first[0]
        if b < len(score):
            free += (self.move[0] + score[b] + behind[b]).max()
        return float((ahead[-1]).max() - free)


def _lse(x: np.ndarray, axis: int):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[str] | None = None) -> Crf:
    net = Crf()
    net.fit(table or LABELLED)
    return net


# ---------------------------------------------------------------- spans
#: Tokens around a seed that belong to its run; the least margin of a span.
_REACH = 4
MARGIN = 1.0
_HIT = re.compile(r"[0-9@]|\b[dD][oO][tT]\b")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_BLANKS = " \t\n\x0b\f\r"


def seeds(text: str):
    """Tokens (start, end) with a digit, an @ or the word dot, in linear time."""
    done = 0
    m = _HIT.search(text)
    while m:
        a = m.start()
        while a > done and text[a - 1] not in _BLANKS:
            a -= 1
        e = _BLANK.search(text, m.end())
        done = e.start() if e else len(text)
        yield a, done
        m = _HIT.search(text, done)


#: Bounds of one batch of runs: how many, and their tokens after padding.  A longer run is a batch of its own, never cut.
_BATCH, _CELLS = 512, 1 << 15


def _before(text: str, start: int, end: int, count: int) -> list[tuple[int, int]]:
    """The last ``count`` tokens between ``end`` and ``start``, or all if there are fewer."""
    out, b = [], start
    while len(out) < count:
        while b > end and text[b - 1] in _BLANKS:
            b -= 1
        if b == end:
            break
        a = b
        while a > end and text[a - 1] not in _BLANKS:
            a -= 1
        out.append((a, b))
        b = a
    return out[::-1]


def segments(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens (start, end) around the seeds, with ``_REACH`` tokens to either side."""
    out: list[list[tuple[int, int]]] = []
    end = 0

    def tail(stop: int) -> None:
        for k, x in enumerate(_TOKEN.finditer(text, end, stop)):
            if k == _REACH:
                break
            out[-1].append(x.span())

    for start, stop in seeds(text):
        before = _before(text, start, end, 2 * _REACH + 1)
        if out and len(before) <= 2 * _REACH:
            out[-1].extend([*before, (start, stop)])
        else:
            if out:
                tail(start)
            out.append([*before[-_REACH:], (start, stop)])
        end = stop
    if out:
        tail(len(text))
    return out


def _holds(kind: int, s: str) -> bool:
    """Whether digits can be a number of their kind at all: a card passes Luhn, the parts of an address stay under 256."""
    d = _only_digits(s)
    if KINDS[kind] == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if KINDS[kind] == "ip":
        return len(parts := _DIGITS.findall(s)) == 4 and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts)
    return KINDS[kind] != "phone" or 7 <= len(d) <= 15


def _batches(work: list):
    """``work``, sorted by length, in batches of bounded size."""
    part: list = []
    for w in work:
        if part and (len(part) == _BATCH or (len(part) + 1) * len(w[1]) > _CELLS):
            yield part
            part = []
        part.append(w)
    if part:
        yield part


def crf_spans(net: Crf, texts: list[str], known: list[list[tuple[int, int, int]]], least: float = MARGIN) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to the known ones, for a batch of texts."""
    work = [(i, seg) for i, t in enumerate(texts) if _HIT.search(t) for seg in segments(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    work.sort(key=lambda w: len(w[1]))
    # what is already in a span, by code point
    taken = {i: bytearray(len(texts[i])) for i, _ in work}
    for i, marks in taken.items():
        for _, x, y in known[i]:
            marks[x:y] = b"\1" * (y - x)
    for part in _batches(work):
        size = np.array([len(seg) for _, seg in part])
        score = np.zeros((len(part), size.max(), len(LABELS)))
        for r, (i, seg) in enumerate(part):
            score[r, : size[r]] = net.scores([texts[i][a:b] for a, b in seg])
        tags, ahead, behind = net.viterbi(score, size)
        for r in np.flatnonzero((tags * (np.arange(tags.shape[1]) < size[:, None])).any(axis=1)):
            i, seg = part[r]
            t = 0
            while t < len(seg):
                g = tags[r, t]
                if not g:
                    t += 1
                    continue
                kind, u = (int(g) - 1) // 2, t + 1
                while u < len(seg) and tags[r, u] == 2 + 2 * kind:
                    u += 1
                a, b = seg[t][0], seg[u - 1][1]
                while a < b and texts[i][a] in _EDGE and not (KINDS[kind] == "phone" and texts[i][a] == "("):
                    a += 1
                while b > a and texts[i][b - 1] in _EDGE:
                    b -= 1
                if a < b and taken[i].find(1, a, b) < 0 and _holds(kind, texts[i][a:b]) and net.margin(score[r, : size[r]], ahead[r, : size[r]], behind[r, : size[r]], t, u) >= least:
                    out[i].append((kind, a, b))
                    taken[i][a:b] = b"\1" * (b - a)
                t = u
    return out


def held_out_quality(net: Crf, table: list[str] | None = None) -> tuple[float, float]:
    """Precision and recall of patterns and field together on labelled lines, by exact spans."""
    lines = [labelled_tokens(x) for x in table or HELD_OUT]
    texts = [x[0] for x in lines]
    base = [base_spans(t) for t in texts]
    got = [set(b) | set(m) for b, m in zip(base, crf_spans(net, texts, base))]
    right = sum(len(g & set(x[3])) for g, x in zip(got, lines))
    return right / max(1, sum(map(len, got))), right / max(1, sum(len(x[3]) for x in lines))


def _find(sent):
    def run(batches):
        net: Crf = sent.value
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = crf_spans(net, texts, base)
                say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
                cols = [part.column(0)]
                cols += [pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in range(BASE)]
                cols.append(pa.array([hashlib.sha256(say(b).encode()).hexdigest() for b in base]))
                cols.append(pa.array([say(sorted(b + m)) for b, m in zip(base, more)]))
                cols += [pa.array([f(b, m) for b, m in zip(base, more)], pa.int64()) for f in (lambda b, m: len(m), lambda b, m: len(b) + len(m))]
                yield pa.record_batch(cols, names=["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_added", "n_spans"])

    return tidy(run)


def personal_data(docs: DataFrame, net: Crf | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the patterns' spans, their digest, all spans.

    ``spans`` lists kind:start:end in code points, by kind and start, secrets last;
    n_added counts those of the field, n_spans all.  A null text is empty; empty
    texts have no spans.  Rows that repeat are returned as often; other columns are
    ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    net = net or train()
    net.known.clear()
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS[:BASE]) + ", base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_find(spark.sparkContext.broadcast(net)), cols)


def redact(text: str, spans: str) -> str:
    """``text`` with each span of a ``spans`` column replaced by its kind in capitals."""
    for item in sorted((x.split(":") for x in spans.split(",") if x), key=lambda x: -int(x[1])):
        text = text[: int(item[1])] + f"[{item[0].upper()}]" + text[int(item[2]) :]
    return text
