"""Personal data: fixed patterns, and a conditional random field over word shapes.

The patterns find e-mail addresses, IP addresses, card and phone numbers.  The random field
adds what they miss, such as numbers written without a plus sign, and secrets behind a
name like ``token``.  It reads chains of words around every word that holds a digit, ``@``
or ``=``; words farther away can't be part of such data.  What it labels counts only if it
also has the form of its kind, and never replaces what a pattern found.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame

from ledgerloom.llm import crf, labelled
from ledgerloom.llm.common import over_texts

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
AROUND = 4  # plain words on each side of a chain
GAP_CHARS = 100  # chains end where nothing of interest comes within so many characters

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried at its first digit only: later ones could match no more.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@=]")
_WORD = re.compile(r"\S+")
_SPACE = re.compile(r"\s")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_SECRET_NAME = re.compile(r"[A-Za-z0-9_.-]*=|[A-Za-z_-]+:")
QUOTES = "\"'"

_NAMES = frozenset(
    "mail email contact write host server ip from address adresse card karte visa tarjeta number no paid call tel telefon phone "
    "mobile fax ring text reach numéro llama token key api secret password passwort aws bearer authorization commit sha1 checksum "
    "uuid id isbn order part case flight model code rows data years population price version page pages chapter in on at of "
    "and the year".split()
)
# Words that announce a kind, or a number that is nobody's (fixed values).
_CUES = {
    word: kind
    for kind, words in {
        "email": "mail email contact write e-mail",
        "ip": "host server ip adresse ping",
        "card": "card karte visa tarjeta mastercard carte",
        "phone": "call tel telefon phone mobile cell home handy fax ring reach text dial numéro llama teléfono",
        "secret": "token key apikey secret password passwort passwd pwd contraseña bearer credential",
        "plain": "commit sha1 sha256 md5 checksum hash uuid id isbn order part case flight model code rows data years "
        "population price version page pages chapter section room item",
    }.items()
    for word in words.split()
}
_CUE_REACH = AROUND
_LAST_NAME = re.compile(r"[^_.-]*\Z")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each fixed pattern that pass its test."""
    found = {kind: [] for kind in BASE_KINDS}
    if "@" in text:
        # Each match holds one @: its name reaches back to the last match at most.
        end, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                end = domain.end()
                found["email"].append((start, end))
            at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if is_card(m.group(), 16):
                found["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                    found["phone"].append(m.span())
    return found


def is_card(text: str, least: int) -> bool:
    """Whether the digits of a text are ``least`` to 19 and pass the Luhn test."""
    if len(text) > 64:
        return False
    digits = [int(c) for c in text if c in "0123456789"]
    doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return least <= len(digits) <= 19 and (sum(digits[::-2]) + sum(doubled)) % 10 == 0


def shape(word: str) -> str:
    """Letters as a or A, hexadecimal runs as h, digits as 9; runs of more than four cut."""
    out, run = [], 0
    for c in word:
        kind = "9" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c
        run = run + 1 if out and out[-1] == kind else 1
        if run <= 4:
            out.append(kind)
    return "".join(out)


def _features(words: list[str]) -> list[list[int]]:
    """Numbers of the features of each word of a chain: its shape, name and make-up, the
    shapes and names of the words around it, and the last word before it that announces a kind."""
    own, cues, cue, since = [], [], "", 0
    for word in words:
        bare = word.strip(".,;:!?\"'()")
        name, sign, value = bare.partition("=")
        if not sign:
            name, _, value = bare.partition(":")
        name = _LAST_NAME.search(name).group().lower()
        cue, since = (_CUES[name], 0) if name in _CUES else (cue, since + 1)
        cues.append(cue if since <= _CUE_REACH else "")
        digits = sum(c in "0123456789" for c in word)
        marks = value or bare
        own.append(
            (
                "s" + shape(word),
                "n" + (name if name in _NAMES else "-"),
                f"d{min(digits, 5)}{min(digits // 8, 3)}",
                f"@{'@' in word}={'=' in word}{bool(value)}",
                f"h{bool(_HEX.match(marks.strip(QUOTES)))}{min(len(marks) // 6, 4)}",
                f"p{word.count('.')}{word.count('-')}{'(' in word}{word[:1] == '+'}",
            )
        )
    edge = ("edge",)
    rows = []
    for i, mine in enumerate(own):
        names = ["bias", *mine, mine[0] + mine[2], mine[1] + mine[4], "c" + cues[i], "c" + cues[i] + mine[2], "c" + cues[i] + mine[4]]
        for step in (-2, -1, 1, 2):
            other = own[i + step] if 0 <= i + step < len(own) else edge
            names += [f"{step}{x}" for x in other[:3]]
        before, after = own[i - 1][0] if i else edge[0], own[i + 1][0] if i + 1 < len(own) else edge[0]
        names += [f"{before} {mine[0]}", f"{mine[0]} {after} ", f"{before} {mine[0]} {after}"]
        rows.append([crf.feature_number(n) for n in names])
    return rows


def labelled_chain(text: str, kind: str | None, start: int, end: int) -> tuple[list[str], list[str]]:
    """The words of a labelled line and their tags."""
    words = list(_WORD.finditer(text))
    hits = [bool(kind) and w.start() < end and start < w.end() for w in words]
    tags = [f"{'I' if w.start() > start else 'B'}-{kind}" if hit else "O" for w, hit in zip(words, hits)]
    return [w.group() for w in words], tags


def trained_on(rows: Iterable[tuple[str, str | None, int, int]]) -> crf.Crf:
    """The random field of labelled lines (text, kind or None, start, end of the value)."""
    lines = [labelled_chain(*row) for row in rows]
    return crf.trained([_features(words) for words, _ in lines], [tags for _, tags in lines])


@cache
def trained_model() -> crf.Crf:
    return trained_on(labelled.table())


def chains_of(text: str) -> list[list[tuple[int, int]]]:
    """Chains of words (start, end): each word with a digit, ``@`` or ``=``, the words between
    such words if they are near, and AROUND plain words on both sides."""
    cores: list[tuple[int, int]] = []
    found = _TRIGGER.search(text)
    while found:
        start, end = found.start(), cores[-1][1] if cores else 0
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, found.end())
        cores.append((start, stop.start() if stop else len(text)))
        found = _TRIGGER.search(text, cores[-1][1])
    chains: list[list[tuple[int, int]]] = []
    for at, core in enumerate(cores):
        begin = cores[at - 1][1] if at else 0
        offset = max(begin, core[0] - GAP_CHARS)
        while offset > begin and not text[offset - 1].isspace():  # whole words
            offset -= 1
        between = text[offset : core[0]]
        words = [(m.start() + offset, m.end() + offset) for m in _WORD.finditer(between)]
        joined = at and core[0] - begin <= GAP_CHARS and len(words) <= 2 * AROUND
        if joined:
            chains[-1] += [*words, core]
        else:
            if at:
                chains[-1] += _after(text, begin, core[0])
            chains.append([*words[-AROUND:], core])
    if cores:
        chains[-1] += _after(text, cores[-1][1], len(text))
    return chains


def _after(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    stop = _SPACE.search(text, begin + GAP_CHARS, end) if begin + GAP_CHARS < end else None
    words = _WORD.finditer(text, begin, stop.start() if stop else end)
    return [m.span() for _, m in zip(range(AROUND), words)]


def _trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    if kind == "secret":
        name = _SECRET_NAME.match(text, start, end)
        if name and name.end() < end:
            start = name.end()
        if text[start] in QUOTES:  # what follows the closing quote is no part of it
            close = text.find(text[start], start + 1, end)
            end = close if close > 0 else end
    while end > start and text[end - 1] in ".,;:!?\"')]" and not (kind == "phone" and text[end - 1] == ")"):
        end -= 1
    while start < end and text[start] in "\"'[" + ("" if kind == "phone" else "("):
        start += 1
    return start, end


def _has_form(piece: str, kind: str) -> bool:
    digits = sum(c in "0123456789" for c in piece)
    letters = sum(c.isalpha() for c in piece)
    if kind == "email":
        return piece.count("@") == 1 and "." in piece.split("@")[1]
    if kind == "ip":
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return not letters and is_card(piece, 13)
    if kind == "phone":
        return not letters and 9 <= digits <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*", piece))
    return len(piece) >= 12 and digits >= (3 if len(piece) < 16 else 1) and letters >= 3 and not _SPACE.search(piece) and piece.isascii()


def spans_of(texts: list[str | None], model: crf.Crf | None = None) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text the pattern matches by kind, and all spans (kind, start, end): those
    and what the random field adds, in order of kind and start."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    chains = [(i, chain) for i, t in enumerate(texts) for chain in chains_of(t)]
    more: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if chains:
        tags = crf.decoded([_features([texts[i][a:b] for a, b in chain]) for i, chain in chains], model or trained_model())
        taken = [_merged(s for spans in b.values() for s in spans) for b in base]
        for (i, chain), labels in zip(chains, tags):
            at = 0
            while at < len(chain):
                label = labels[at]
                stop = at + 1
                if label == "O":
                    at = stop
                    continue
                kind = label[2:]
                while stop < len(chain) and labels[stop] == "I-" + kind:
                    stop += 1
                start, end = _trimmed(texts[i], chain[at][0], chain[stop - 1][1], kind)
                starts, ends = taken[i]
                before = bisect_left(starts, end)
                free = not before or ends[before - 1] <= start
                if end > start and free and _has_form(texts[i][start:end], kind):
                    more[i].append((kind, start, end))
                at = stop
    out = []
    for own, extra in zip(base, more):
        spans = [(kind, *s) for kind in BASE_KINDS for s in own[kind]] + sorted(set(extra))
        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        out.append((own, spans))
    return out


def _merged(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become
    one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def found(docs: DataFrame, carried: list[str], text: str = "text") -> DataFrame:
    """Personal data in every whole document: the carried columns, ``n_email``, ``n_ip``,
    ``n_card``, ``n_phone`` (matches of the patterns), ``base`` and ``spans`` (kind:start:end in
    code points, end exclusive, comma-joined, the second with what the method adds) and
    ``masked``, the text with all spans replaced.

    A null text counts as empty and stays null when masked; a text without spans stays as
    it is.  Repeated rows are treated alike; no rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained_model())

    def make():
        known = model.value

        def work(texts):
            columns: list[list] = [[] for _ in range(7)]
            for given, (base, spans) in zip(texts, spans_of(texts, known)):
                row = [len(base[k]) for k in BASE_KINDS]
                row.append(joined([(k, *s) for k in BASE_KINDS for s in base[k]]))
                row += [joined(spans), masked(given, spans) if spans else given]
                for column, value in zip(columns, row):
                    column.append(value)
            return columns

        return work

    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return over_texts(docs, carried, text, f"{counts}, base string, spans string, masked string", make)
