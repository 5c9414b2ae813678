"""Operator 2: secrets by pattern and by token efficiency."""

from __future__ import annotations

import base64
import re
import string

from pyspark.sql import DataFrame

from geoloom.llm.common import Overlaps, Span, map_rows, sha256, span_list, vocabulary_path

# Fixed values of the base rules.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the bound equals dropping the shorter ones

# A random string is looked for in runs of these characters: in the whole run if it mixes letters and digits,
# is letters alone, or is letters and signs whose case changes within a word; else in its long stretches of letters.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
_CASES = re.compile(r"[^0-9]*[a-z][A-Z][^0-9]*")
_LETTERS = re.compile(r"[A-Za-z]{16,}")
_ALPHABET = string.ascii_lowercase * 2
# Known digests and identifiers: hexadecimal digests of the usual lengths (also with
# the algorithm's name), UUIDs, and dates or version numbers with words around them.
_DIGEST = re.compile(
    r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=]?)?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    re.I,
)
_WORDY = re.compile(r"(?:[A-Za-z]+|[0-9]{1,8})(?:[-_/=+](?:[A-Za-z]+|[0-9]{1,8}))*")

# Within longer stretches, a random string is looked for in pieces between the separators of addresses, calls and lists.
_PIECE = re.compile(r"[A-Za-z0-9+_.~!@#$%^*-]{16,}")
_NAMED = re.compile(r"(?:[A-Za-z]{1,12}[0-9]{0,4}|[0-9]{1,8}[A-Za-z]{0,3})(?:[-_+.@~]+(?:[A-Za-z]{1,12}[0-9]{0,4}|[0-9]{1,8}[A-Za-z]{0,3}))*")
# The same inside a longer run, and signs that don't belong to a string when they stand at its ends.
_INNER = re.compile(rf"(?<![A-Za-z0-9])(?:{_DIGEST.pattern})(?![A-Za-z0-9])", re.I)
_TRIM = "-._~!*+@"
#: Characters of a random string at least, the share of a piece from which on the whole piece is reported, and the shares of letters and digits in it.
LEAST, WHOLE, ALNUM, LETTER = 16, 0.6, 0.7, 0.3

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """A tiktoken encoder over a rank file, one per worker process."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[vocabulary] = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def base_spans(text: str) -> list[Span]:
    """Spans of the three base rules, leftmost and non-overlapping per kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def dense_windows(lengths: list[int], ratio: float) -> list[tuple[int, int]]:
    """The disjoint windows (first and end character) of a string, cut into tokens of
    these lengths, in which characters per token fall furthest below ratio: the
    maximal scoring stretches where a token scores ratio less its length."""
    # Candidates: start, end, score before the start, score at the end, and the place of the last
    # earlier candidate that starts lower. Each is passed over once, so the time is linear.
    out: list[tuple[int, int, float, float, int]] = []
    at, total = 0, 0.0
    for n in lengths:
        score = ratio - n
        before, total = total, total + score
        if score > 0:
            start, low, k = at, before, len(out) - 1
            while True:
                while k >= 0 and out[k][2] >= low:
                    k = out[k][4]
                if k < 0 or out[k][3] >= total:
                    break
                start, _, low, _, before_k = out[k]
                del out[k:]
                k = before_k
            out.append((start, at + n, low, total, k))
        at += n
    return [(a, b) for a, b, *_ in out]


def random_spans(text: str, encoding, ratio: float) -> list[Span]:
    """Runs, or stretches of 16 or more letters in them, whose characters per
    token fall below ``ratio`` and that are no known digest, identifier or
    alphabet; then windows of that kind in longer pieces with other signs."""

    def random(s: str) -> bool:
        s = _INNER.sub("", s)
        return len(s) >= LEAST and s.lower() not in _ALPHABET and len(s) < ratio * len(encoding.encode_ordinary(s))

    found: list[Span] = []
    for m in _RUN.finditer(text):
        s = m[0]
        if s.isdigit() or _DIGEST.fullmatch(s):
            continue
        whole = s.isalpha() or (not _WORDY.fullmatch(s) if _MIXED.match(s) else _CASES.fullmatch(s))
        if whole and random(s):
            found.append(("random", m.start(), m.end()))
        elif not s.isalpha():
            found += [("random", m.start() + x.start(), m.start() + x.end()) for x in _LETTERS.finditer(s) if random(x[0])]
    for m in _PIECE.finditer(text):
        s = m[0]
        if _RUN.fullmatch(s) or _DIGEST.fullmatch(s):
            continue
        lengths = [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(s)]
        for a, b in dense_windows(lengths, ratio):
            if b - a >= WHOLE * len(s):
                a, b = 0, len(s)
            a, b = a + len(s[a:b]) - len(s[a:b].lstrip(_TRIM)), b - (len(s[a:b]) - len(s[a:b].rstrip(_TRIM)))
            t = s[a:b]
            letters, digits = sum(map(str.isalpha, t)), sum(map(str.isdigit, t))
            if len(t) >= LEAST and letters >= LETTER * len(t) and letters + digits >= ALNUM * len(t) and not _NAMED.fullmatch(t) and random(t):
                found.append(("random", m.start() + a, m.start() + b))
    # Of finds that overlap, one after another, the longest stays.
    out: list[Span] = []
    for x in sorted(set(found), key=lambda x: (x[1], -x[2])):
        if out and x[1] < out[-1][2]:
            if x[2] - x[1] > out[-1][2] - out[-1][1]:
                out[-1] = x
        else:
            out.append(x)
    return out


def scan_secrets(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ratio: float = 2.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``spans`` (list of kind, start, end; code points, end exclusive).

    Kinds assign, access and hex follow the base rules; kind random holds runs
    of 16 or more characters whose ratio of characters to tokens is below
    ``ratio``: runs mixing letters and digits, of letters alone, of letters and
    signs with changes of case within a word, and stretches of 16 or more
    letters within other runs; then windows of that ratio inside longer pieces
    (parts of an address, strings with other signs among them); unless they lie
    inside a base span or are a known digest, a UUID, an alphabet or words and
    short numbers in a row. Numbers alone are none: they have about three digits
    a token however random. A null text is empty; very long texts are scanned
    whole; an empty table gives an empty one; repeated rows give repeated
    results; other columns, whatever their names, are not read. One narrow pass:
    no shuffle.
    """

    def fn(ids: list, texts: list) -> dict:
        encoding = encoder(vocabulary)
        spans = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            where = Overlaps(base)
            extra = [x for x in random_spans(text, encoding, ratio) if not any(a <= x[1] and x[2] <= b for _, a, b in where.over(x[1], x[2]))]
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base + extra])
        return {id_col: ids, "spans": spans}

    return map_rows(docs, [id_col, text_col], fn, f"{id_col} long, spans array<struct<kind:string,start:long,end:long>>")


def secret_digest(docs: DataFrame, **how) -> DataFrame:
    """The digest columns of :func:`scan_secrets`: counts of the base kinds, the
    SHA-256 of the base spans and the list of all spans."""

    def fn(ids: list, found: list) -> dict:
        rows = [[(s["kind"], s["start"], s["end"]) for s in x] for x in found]
        base = [[s for s in x if s[0] != "random"] for x in rows]
        return {
            "doc_id": ids,
            **{f"n_{k}": [sum(s[0] == k for s in x) for x in base] for k in KINDS[:3]},
            "base_sha256": [sha256(span_list(x, KINDS)) for x in base],
            "spans": [span_list(x, KINDS) for x in rows],
        }

    return map_rows(
        scan_secrets(docs, **how), ["doc_id", "spans"], fn, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
