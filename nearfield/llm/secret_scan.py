"""Secret scans: fixed patterns, and sliding-window entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from nearfield.llm.common import map_text

# The base patterns, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: For each class: its runs, the window and the least entropy of a window in bits.
CLASSES = (
    (re.compile(r"[0-9a-fA-F]{20,}"), 20, 2.9),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.8),
)


def _ascending(letters: str) -> str:
    """Ten letters of a counting sequence, and as many more as follow."""
    return letters[:10] + "(?:".join(["", *letters[10:]]) + ")?" * len(letters[10:])


#: What these match in a candidate is no secret: identifiers, counting sequences, the word of a placeholder itself, the key
#: that cloud manuals print, paths. The rest of the candidate is scanned, also what follows a placeholder directly. Each
#: pattern ends within a bounded length, or is tried at a candidate's start only, so that a long run is read once.
ALLOW = (
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "|".join(map(_ascending, ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))),
    r"(?<![A-Za-z0-9])(?:example|EXAMPLE|placeholder|PLACEHOLDER|changeme|lorem)",
    r"wJalrXUtnFEMI/?K7MDENG/?bPxRfiCY(?:EXAMPLEKEY|zEXAMPLEKEY)",
    r"EXAMPLE(?:KEY)?(?![A-Za-z0-9+/=_-])",
    r"^/{0,2}[a-z]{1,19}(?:/[a-z_-]{1,19}){2,}$",
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CONSONANTS = re.compile(r"[^aeiouy]{8}", re.I)
_TERM = [0.0] + [c * math.log2(c) for c in range(1, 257)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order."""
    lower = text.lower()
    spans = []
    # lower() may change a text's length, but it keeps every ASCII keyword findable.
    if any(w in lower for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def like_words(text: str) -> bool:
    """Whether most letters lie in words: three letters or more in one case (a capital may lead) that can be spoken."""
    words = [w for w in _WORD.findall(text) if len(w) > 2 and not _CONSONANTS.search(w)]
    spoken = sum(len(w) for w in words if 4 * sum(map(w.lower().count, "aeiouy")) >= len(w))
    return 10 * spoken >= 7 * sum(map(str.isalpha, text))


def dense_windows(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged windows of ``run`` with ``least`` bits of entropy or more that hold a letter, and a digit unless the letters are unlike words.

    Counts change by the character that leaves and the one that enters; the entropy of a window of w characters is
    log2(w) less the mean of c * log2(c) over its counts c.
    """
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    need = (math.log2(window) - least) * window + 1e-9
    found: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += _TERM[k + 1] - _TERM[k]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= window:
            old = run[i - window]
            k = counts[old]
            counts[old] = k - 1
            total += _TERM[k - 1] - _TERM[k]
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i >= window - 1 and total <= need and letters and (digits or not like_words(run[i - window + 1 : i + 1])):
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def outside(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of start to end without ``spans``, which are in order of their starts."""
    left = []
    for s, e in spans:
        if e > start and s < end:
            if s > start:
                left.append((start, s))
            start = e
    return [*left, (start, end)] if start < end else left


def entropy_spans(text: str, base: list[tuple[int, int, int]], allow: re.Pattern) -> list[tuple[int, int, int]]:
    """Spans of dense windows in candidate strings, merged over classes, outside the allow list's matches and ``base``."""
    spans = []
    starts, reached = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        harmless = [(m.start() + x.start(), m.start() + x.end()) for x in allow.finditer(m[0])]
        met = base[bisect_right(reached, m.start()) : bisect_left(starts, m.end())]
        for at, to in outside(m.start(), m.end(), sorted(harmless + [(s, e) for s, _, e in met])):
            for runs, window, least in CLASSES:
                for r in runs.finditer(text, at, to):
                    spans += [(r.start() + a, r.start() + b) for a, b in dense_windows(r[0], window, least)]
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, 3, b) for a, b in merged]


def scan(text: str | None, allow: re.Pattern) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text or "")
    return base, sorted(base + entropy_spans(text or "", base, allow))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(df: DataFrame, text: str = "text", keep: list[str] | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Each row's counts of base spans, their digest, and all spans with what they hold.

    Spans count code points, end exclusive. ``found`` has kind, start, end and the matched characters. A null text is
    an empty one and has none. Entropy windows lie wholly outside base spans. What the allow list matches in a candidate is left
    out of entropy windows, the rest of it is not. Rows are scanned one by one, repeated ones and null keys too; an empty
    table gives none. Time grows in proportion to a text's length, also where it is one long run (a million characters:
    some seconds). Only ``keep`` and the new columns come out, so other columns may have any name.
    """
    pattern = "|".join(f"(?:{a})" for a in allow) or r"(?!)"

    def fn(texts: list[str | None]) -> dict:
        allowed = re.compile(pattern)
        out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")}
        for t in texts:
            base, all_ = scan(t, allowed)
            for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                out[c].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(all_))
            out["found"].append([{"kind": KINDS[k], "start": a, "end": b, "value": t[a:b]} for a, k, b in all_])
        return out

    found = "found array<struct<kind: string, start: int, end: int, value: string>>"
    return map_text(df, text, keep or ["doc_id"], fn, f"n_assign long, n_access long, n_hex long, base_sha256 string, spans string, {found}")


def op5(df: DataFrame) -> DataFrame:
    return secret_spans(df).drop("found")
