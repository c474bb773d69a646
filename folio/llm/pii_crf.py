"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans come from fixed patterns. The field labels words that hold a digit, an `@` or a written-out one (`[at]`, with the words of
its address) as one of five kinds (the four of the patterns, and secrets such as access tokens) or none; all other words can only be none,
so they need no node. Neighbouring words are linked in a chain, so that the groups of a number written with spaces are one. Each word is also
linked with the last earlier one that is the same or similar, however far away: equal digits whatever stands between them, numbers that end in the same
eight digits, secrets with the same first sixteen characters, addresses that differ in how @ and dots are written. Loopy belief propagation over both kinds
of link makes them agree on a label across the document: a token that a cue introduces once is a secret where it stands
bare too, and a number that is once called an order's is no card elsewhere. Runs of words of one kind with a marginal of `sure` or more
that touch no base span are added.

The field is fitted piecewise on a bounded sample (the `sample` documents with candidate words and the least hashes). Each text is
used as it stands, labelled by its base spans and by cues (`token =`) before secrets; with its spans in forms that the base patterns miss
(a card number that fails its check, with spaces or without; a phone number without `+`; an address in words), still labelled; with other things
in their places (dates, versions, shorter numbers, handles; numbers and hashes that a word such as order or commit introduces), labelled none; and with
repeats that stand bare and share the label of the first. A bare token without a cue is shown as a secret and as none, so alone it decides nothing.
Word weights come from multinomial logistic regression, link weights from label counts.

Defined cases: null text counts as empty; texts of any length are scanned whole in linear time; repeated rows give
repeated results; where the sample has no candidate words only base spans are found; an empty table gives an empty
result. Only doc_id and text are read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textkit as tk
from folio.llm.frames import hashed_sample

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = r"[0-9@]|[\[(] ?at ?[\])]"
HIT, SPACE = re.compile(CANDIDATE), re.compile(r"[\x20\x09-\x0D]")
AT = re.compile(r"@|[\[(] ?at ?[\])]")
#: A written-out @, and the rest of an address after it.
SPELLED, AFTER_AT = re.compile(r"[\[(] ?at ?[\])]"), re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]|(?<= )dot(?= )) ?[A-Za-z0-9-]+)+")
DOT = re.compile(r" ?(?:[\[(] ?dot ?[\])]|(?<= )dot(?= )) ?")
GROUP = re.compile(r"[(]?[0-9]{1,6}[)]?(?:[-.][0-9]{1,6})*")
NATIONAL = re.compile(r"[(]?[0-9]{2,4}[)]?[-.][0-9]{3}[-.][0-9]{4}")
SECRET = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SECRET_CUES = frozenset("token key secret password passwd pwd apikey api_key bearer auth credential access_token".split())
PHONE_CUES = frozenset("phone tel telephone mobile cell fax call ring dial".split())
#: What such numbers and hashes are of that are nobody's own.
OBJECT_CUES = frozenset("order invoice parcel shipment tracking ticket serial sku isbn item article part commit revision hash checksum md5 sha1 sha256 build digest blob".split())
OTHER_CUES = frozenset("card visa mastercard credit phone tel telephone mobile fax call mail email contact ip host address".split())
WHITE = " \t\n\x0b\f\r"
NOT_DIGIT = re.compile(r"[^0-9]")
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 13, "phone": 7, "secret": 0}
SAMPLE = 2_000
#: How much more than others those words weigh in training that a word calls an object's: nothing else about them is unlike the rest.
OBJECT_WEIGHT = 24.0
SPAN = "array<struct<kind: string, start: int, end: int>>"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of LOCAL@DOMAIN: before each @ the local part is all that can be, up to the match before."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at - len(m[0]) if (m := LOCAL.match(text[low:at][::-1])) else at
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start; matches that fail their check are dropped without another try."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the words that hold a digit or @; an address with a written-out @ is one, with the words that it is made of."""
    out, low = [], 0
    while m := HIT.search(text, low):
        start = max(low, *[text.rfind(c, low, m.start()) + 1 for c in WHITE])
        rest = AFTER_AT.match(text, m.end()) if SPELLED.fullmatch(m[0]) else None
        if rest:
            # the word before, if @ stands by itself
            before = m.start() - 1 if m.start() > low and text[m.start() - 1] == " " else m.start()
            own = LOCAL.match(text[max(low, *[text.rfind(c, low, before) + 1 for c in WHITE]) : before][::-1])
            if own:
                start = before - len(own[0])
            elif out and out[-1][1] == before and LOCAL.fullmatch(text, *out[-1]):
                start = out.pop()[0]
        gap = SPACE.search(text, rest.end() if rest else m.end())
        low = gap.start() if gap else len(text)
        out.append((start, low))
    return out


class Graph(NamedTuple):
    """The candidate words of some documents: features, and links as pairs of words."""

    doc: np.ndarray
    span: np.ndarray
    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def secret_part(word: str) -> re.Match | None:
    """The longest run of a word that may be a secret: 16 or more letters and digits of both kinds."""
    found = [m for m in SECRET.finditer(word) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return max(found, key=lambda m: len(m[0]), default=None)


def word_features(word: str) -> list[float]:
    digits = NOT_DIGIT.sub("", word)
    n, core = len(digits), word.strip(".,;:!?()[]\"'#*$%&|<>=")
    parts = core.split(".")
    dotted = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    at = AT.search(core)
    local, domain = (core[: at.start()], core[at.end() :]) if at else ("", "")
    secret = secret_part(word)
    return [
        1.0, bool(at), bool(at and local and "." in domain.strip(".")), n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 12, 13 <= n <= 19, n > 19,
        core.isdigit(), dotted, dotted and all(len(p) <= 3 and int(p) <= 255 for p in parts), word.startswith("+"), "(" in word and ")" in word, "-" in core, "." in core,
        any(c.isalpha() for c in core), 13 <= n <= 19 and luhn(digits), len(core) - n > n, bool(secret), bool(secret and len(secret[0]) >= 24), core.count("-") == 2 and n == 8, core.isdigit() and 13 <= n <= 19,
        bool(NATIONAL.fullmatch(core)), core.startswith("00") and n >= 4, bool(at and DOT.search(domain)),
    ]


#: Places of features: of the word itself, then of what follows it, what is before it, the run of digit groups that it is in, and the words before that.
PLUS, BRACKETS, DASH, SHAPED, LONG = 13, 14, 15, 20, 23
OWN = 27
NEXT, NEXT_PHONE, JOINED, AFTER_PHONE, RUN_CARD, RUN_FOURS, RUN_YEARS, RUN_PHONE, RUN_ZEROS, SECRET_CUE, OTHER_CUE, PHONE_CUE, OBJECT_CUE, OBJECT_LONG, OBJECT_SHAPED, RUN_OBJECT = range(OWN, OWN + 16)
N_FEATURES = OWN + 16


def cues(text: str, start: int) -> tuple[bool, bool, bool, bool]:
    """Whether the words shortly before a place name a secret, another kind, a phone, or an object."""
    before = [w.strip(".,;:!?()[]\"'=#*$%&").lower() for w in re.split(r"[\s=:]+", text[max(0, start - 40) : start])[-4:]]
    return tuple(any(w in names for w in before) for names in (SECRET_CUES, OTHER_CUES, PHONE_CUES, OBJECT_CUES))


def similar(word: str, digits: str) -> list[str]:
    """Keys that a word shares with those that it is linked with."""
    secret = secret_part(word)
    if secret:
        return [secret[0].lower()[:16]]
    if AT.search(word):
        return [DOT.sub(".", SPELLED.sub("@", word)).replace(" ", "").strip(".,;:!?()#*$%&\"'").lower()]
    if len(digits) >= 8:
        return [digits, "/" + digits[-8:]]
    return [digits] if len(digits) >= 4 else [word.strip(".,;:!?()").lower()]


def group_runs(words: list[str], joined: list[bool]) -> list[tuple[int, int]]:
    """Runs of two or more neighbouring words that are groups of digits: their first and one past their last."""
    out, first = [], None
    for i, word in enumerate([*words, ""]):
        core = word.strip(".,;:!?#*$%&\"'").removeprefix("+")
        fits = bool(GROUP.fullmatch(core)) and not IP.fullmatch(core)
        if first is not None and not (fits and joined[i]):
            if i - first > 1:
                out.append((first, i))
            first = None
        if fits and first is None:
            first = i
    return out


def graph(texts: list[str], docs: list[int]) -> Graph:
    owner, spans, rows, chain, skip = [], [], [], [], []
    for text, doc in zip(texts, docs, strict=True):
        last: dict[str, int] = {}
        places, base = candidates(text), len(rows)
        words = [text[a:b] for a, b in places]
        joined = [i > 0 and not text[places[i - 1][1] : a].strip(WHITE) for i, (a, _) in enumerate(places)]
        runs = {i: run for run in group_runs(words, joined) for i in range(*run)}
        known: dict[int, tuple[bool, bool, bool, bool]] = {}
        for k, ((start, end), word) in enumerate(zip(places, words, strict=True)):
            i, own = base + k, word_features(word)
            if joined[k]:
                chain.append((i - 1, i))
                rows[i - 1][NEXT], rows[i - 1][NEXT_PHONE] = 1.0, float(own[PLUS] or own[BRACKETS] or own[DASH])
            after_phone = joined[k] and (rows[i - 1][PLUS] or rows[i - 1][BRACKETS] or rows[i - 1][JOINED] and rows[i - 1][DASH])
            # the groups of a number share its length, its shape and the words before it
            first, past = runs.get(k, (k, k + 1))
            groups = [NOT_DIGIT.sub("", w) for w in words[first:past]]
            digits, several = "".join(groups), past - first > 1
            fours = several and all(len(g) == 4 for g in groups[:-1]) and 15 <= len(digits) <= 16
            known[k] = known[first] if first != k else cues(text, start)
            secret_cue, other_cue, phone_cue, object_cue = known[k]
            years = several and all(len(g) == 4 and g < "2100" and g >= "1000" for g in groups)
            run = [several and 13 <= len(digits) <= 19 and not digits.startswith("00"), fours, years, several and 7 <= len(digits) <= 15 and not fours, several and digits.startswith("00")]
            around = [*run, secret_cue, other_cue, phone_cue, object_cue, object_cue and own[LONG], object_cue and own[SHAPED], object_cue and several]
            rows.append([*map(float, own), 0.0, 0.0, float(joined[k]), float(after_phone), *map(float, around)])
            owner.append(doc)
            spans.append((start, end))
            keys = similar(word, NOT_DIGIT.sub("", word)) if not several else similar("", digits) if first == k and len(digits) >= 8 else []
            skip += [(j, i) for j in dict.fromkeys(last[x] for x in keys if x in last)]
            last |= dict.fromkeys(keys, i)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(np.array(owner, np.int64), pairs(spans), np.array(rows, float).reshape(-1, N_FEATURES), pairs(chain), pairs(skip))


class Field(NamedTuple):
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # label x label, log potentials
    skip: np.ndarray

    def marginals(self, g: Graph, rounds: int = 30, damping: float = 0.5) -> np.ndarray:
        """Label probabilities of each word by loopy sum-product messages in log space."""
        unary = g.x @ self.weights
        links = np.concatenate([g.chain, g.skip])
        if not len(links):
            return _softmax(unary)
        potential = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
        source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        messages = np.zeros((len(source), unary.shape[1]))
        # each document stops by itself, so that its result doesn't depend on those beside it
        _, own = np.unique(g.doc[source], return_inverse=True)
        live = np.ones(own.max() + 1, bool)
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, messages)
            new = _logsum((belief[source] - messages[back])[:, :, None] + potential)
            new -= new.max(1, keepdims=True)
            change = np.zeros(len(live))
            np.maximum.at(change, own, np.abs(new - messages).max(1))
            moved = live[own]
            messages[moved] = damping * messages[moved] + (1 - damping) * new[moved]
            live &= change >= 1e-4
            if not live.any():
                break
        belief = unary.copy()
        np.add.at(belief, target, messages)
        return _softmax(belief)


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def labels_of(g: Graph, spans: dict[int, list[Span]]) -> np.ndarray:
    """The label of each word: the kind of the span that it overlaps (or `none`), secret by shape and cue, none, or -1 where it looks like a kind without evidence."""
    out = np.zeros(len(g.doc), np.int64)
    for i, (doc, (start, end), x) in enumerate(zip(g.doc.tolist(), g.span.tolist(), g.x, strict=True)):
        for kind, a, b in spans[doc]:
            if a < end and start < b:
                out[i] = 0 if kind == "none" else LABELS.index(kind) + 1
                break
        else:
            if x[OBJECT_CUE]:
                continue
            out[i] = LABELS.index("secret") + 1 if x[SHAPED] and x[SECRET_CUE] else -1 if x[SHAPED] or x[8] or x[RUN_CARD] and not x[RUN_YEARS] else 0
    return out


def rewritten(text: str, spans: list[Span], change) -> tuple[str, list[Span]]:
    """The text with what `change(kind, part)` gives in the place of each span, and where the new parts stand."""
    out, at, found = [], 0, []
    length = 0
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if start < at:
            continue
        new = change(kind, text[start:end])
        out += [text[at:start], new]
        length += start - at + len(new)
        found.append((kind, length - len(new), length))
        at = end
    return "".join(out) + text[at:], found


def disguise(kind: str, part: str) -> str:
    """The same thing in a form that the base patterns miss; which one, its digits say."""
    digits = NOT_DIGIT.sub("", part)
    way = sum(map(int, digits)) % 4
    if kind == "card":
        number = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        return " ".join(number[i : i + 4] for i in range(0, len(number), 4)) if way == 3 else number
    if kind == "phone":
        own = digits[-10:]
        return (part[1:], f"{own[:3]}-{own[3:6]}-{own[6:]}", f"00{digits[:2]} {digits[2:4]} {digits[4:8]} {digits[8:]}", f"({own[:3]}) {own[3:6]}-{own[6:]}")[way]
    if kind == "email":
        name, _, host = part.partition("@")
        return (f"{name}[at]{host}", f"{name} (at) {host.replace('.', ' dot ')}", f"{name}(at){host}", f"{name} [at] {host.replace('.', ' [dot] ')}")[way]
    return part


def mislead(kind: str, part: str) -> str:
    """Something else of a similar form; which one, its digits say."""
    digits = (NOT_DIGIT.sub("", part) + "1" * 8)[:8]
    way = sum(map(int, digits)) % 3
    if kind == "phone":
        return (f"{digits[:4]}-0{digits[4]}-1{digits[5]}", f"{digits[:3]} of {digits[3:6]}", f"{digits[:4]} {digits[4:6]}")[way]
    if kind == "card" and way:
        return " ".join(f"{19 + i % 2}{digits[i : i + 2]}" for i in range(3 + way - 1))
    if kind == "secret":
        return part[:10]
    return digits if kind == "card" else ".".join(part.split(".")[:3]) if kind == "ip" else "@" + part.partition("@")[0]


def named_object(kind: str, part: str) -> str:
    """A number or hash that a word calls an object's."""
    names = sorted(OBJECT_CUES)
    name = names[sum(map(ord, part)) % len(names)]
    if kind == "card":
        return f"{name} {disguise(kind, part)}"
    return f"{name} {part}" if kind == "secret" else mislead(kind, part)


def cued_secrets(text: str) -> list[Span]:
    """Words in the form of a secret that a cue introduces, and no word that names an object."""
    out = []
    for start, end in candidates(text):
        part = secret_part(text[start:end])
        if part:
            secret, _, _, thing = cues(text, start)
            if secret and not thing:
                out.append(("secret", start + part.start(), start + part.end()))
    return out


def repeated(text: str, spans: list[Span], labelled: bool) -> tuple[str, list[Span]]:
    """The text with its cards and secrets once more at its end, each bare between dots; with their label if `labelled`, else with none."""
    out, found = text, list(spans) if labelled else []
    for kind, a, b in spans:
        if kind in ("card", "secret"):
            out += " . "
            found.append((kind if labelled else "none", len(out), len(out) + b - a))
            out += text[a:b]
    return out, found


class Example(NamedTuple):
    """A text with its spans, and from where on its words show how links agree but not how words look."""

    text: str
    spans: list[Span]
    tail: int


def examples(text: str) -> list[Example]:
    """A text; the text with its spans disguised, and these once more; with others in their places; named as objects, and again without the name; and secrets that stand bare."""
    base = base_spans(text)
    spans = sorted({*base, *cued_secrets(text)}, key=lambda s: s[1:])
    out = [Example(text, base, len(text))]
    if not spans:
        return out
    hidden, places = rewritten(text, spans, disguise)
    again, everywhere = repeated(hidden, places, True)
    out += [Example(rewritten(text, spans, mislead)[0], [], len(text) * 2), Example(again, everywhere, len(hidden))]
    things, marks = rewritten(text, spans, named_object)
    # what follows the name is the thing itself
    own = [(k, b - len(things[a:b].split(" ", 1)[-1]), b) for k, a, b in marks if k in ("card", "secret")]
    out.append(Example(*repeated(things, own, False), len(things)))
    secrets = [s for s in spans if s[0] == "secret"]
    if secrets:
        bare = " . ".join(text[a:b] for _, a, b in secrets)
        out += [Example(bare, [(label, 0, len(bare))], len(bare)) for label in ("none", "secret")]
    return out


def fit(g: Graph, y: np.ndarray, shown: np.ndarray, steps: int = 1_500, rate: float = 1.0, decay: float = 3e-4) -> Field:
    """Words that aren't `shown`, and those of unknown label (-1), don't train the word weights."""
    n, sure = len(LABELS) + 1, (y >= 0) & shown
    x, target = g.x[sure], np.eye(n)[y[sure]]
    # rare labels weigh as much as frequent ones
    each = 1 / np.bincount(y[sure], minlength=n)[y[sure]] if sure.any() else np.zeros(0)
    each = each * np.where(x[:, OBJECT_CUE] > 0, OBJECT_WEIGHT, 1.0)
    each = (each / max(each.sum(), 1e-9))[:, None]
    weights = np.zeros((N_FEATURES, n))
    speed = np.zeros_like(weights)
    for _ in range(steps):
        speed = 0.9 * speed - rate * 0.1 * (x.T @ (each * (_softmax(x @ weights) - target)) + decay * weights)
        weights = weights + speed

    def potentials(pairs: np.ndarray, same_way: bool, weight: float) -> np.ndarray:
        pairs = pairs[(y[pairs] >= 0).all(1)]
        seen = np.full((n, n), 0.5) + np.eye(n)
        np.add.at(seen, (y[pairs[:, 0]], y[pairs[:, 1]]), 1)
        seen = seen if same_way else seen + seen.T
        share = seen / seen.sum()
        return weight * np.log(share / np.outer(share.sum(1), share.sum(0)))

    # similar words agree nearly always; neighbours depend on much else that the weights know already
    return Field(weights, potentials(g.chain, True, 0.5), potentials(g.skip, False, 1.0))


def _begins(kind: str, before: str, word: str) -> bool:
    """Whether a word begins a new span of a kind, right after a word of that kind."""
    if kind == "card":
        return max(len(NOT_DIGIT.sub("", w)) for w in (before, word)) >= LEAST_DIGITS["card"]
    return word.startswith(("+", "00")) if kind == "phone" else True


def added_spans(g: Graph, marginals: np.ndarray, texts: dict[int, str], base: dict[int, list[Span]], sure: float) -> dict[int, list[Span]]:
    """Runs of neighbouring words of one kind, trimmed of what isn't theirs, that touch no base span."""
    out: dict[int, list[Span]] = {}
    label, joined = marginals.argmax(1), np.zeros(len(g.doc), bool)
    label[marginals.max(1) < sure] = 0
    joined[g.chain[:, 1]] = True
    taken: dict[int, tuple[list[int], list[int]]] = {}
    i = 0
    while i < len(label):
        j = i + 1
        while j < len(label) and joined[j] and label[j] == label[i] and not _begins(LABELS[label[i] - 1], *(texts[int(g.doc[i])][g.span[k, 0] : g.span[k, 1]] for k in (j - 1, j))):
            j += 1
        if label[i]:
            doc, kind = int(g.doc[i]), LABELS[label[i] - 1]
            start, end = int(g.span[i, 0]), int(g.span[j - 1, 1])
            text = texts[doc]
            if kind == "secret":
                part = secret_part(text[start:end])
                start, end = (start + part.start(), start + part.end()) if part else (start, start)
            while start < end and not (text[end - 1].isalnum() or text[end - 1] in ")=" and kind in ("phone", "secret")):
                end -= 1
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            core = text[start:end]
            if doc not in taken:
                order = sorted(base[doc], key=lambda s: s[1])
                taken[doc] = [s[1] for s in order], list(accumulate((s[2] for s in order), max))
            before = bisect_left(taken[doc][0], end)
            free = not before or taken[doc][1][before - 1] <= start
            if core and free and len(NOT_DIGIT.sub("", core)) >= LEAST_DIGITS[kind] and (kind != "email" or AT.search(core[1:-1])):
                out.setdefault(doc, []).append((kind, start, end))
        i = j
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    some = docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", "text")
    few = hashed_sample(some, "doc_id", sample, some.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [e for t in b.column(1).to_pylist() for e in examples(t)]
            g = graph([e.text for e in made], list(range(len(made))))
            y = labels_of(g, {i: e.spans for i, e in enumerate(made)})
            shown = np.array([a < made[i].tail for i, (a, _) in zip(g.doc.tolist(), g.span.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (g.x, g.chain, g.skip, y, shown)], names=["x", "chain", "skip", "y", "shown"])

    parts, at = [], 0
    for row in few.mapInArrow(run, "x binary, chain binary, skip binary, y binary, shown binary").collect():
        x = np.frombuffer(row.x).reshape(-1, N_FEATURES)
        chain, skip, y, shown = (np.frombuffer(v, np.int64) for v in (row.chain, row.skip, row.y, row.shown))
        parts.append((x, chain.reshape(-1, 2) + at, skip.reshape(-1, 2) + at, y, shown > 0))
        at += len(x)
    if not at:
        return None
    x, chain, skip, y, shown = (np.concatenate(p) for p in zip(*parts, strict=True))
    return fit(Graph(np.zeros(at, np.int64), np.zeros((at, 2), np.int64), x, chain, skip), y, shown)


def find_personal_data(docs: DataFrame, sample: int = SAMPLE, sure: float = 0.9) -> DataFrame:
    """doc_id, base_spans, spans (base and added, by kind as in LABELS, then start), a row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for first, last in tk.slices(b.column(1)):
                part = b.slice(first, last - first)
                some = np.flatnonzero(pc.match_substring_regex(part.column(1), CANDIDATE).fill_null(False).to_numpy(zero_copy_only=False)).tolist()
                texts = {i: part.column(1)[i].as_py() for i in some}
                base = {i: base_spans(t) for i, t in texts.items()}
                added: dict[int, list[Span]] = {}
                if field is not None and some:
                    g = graph(list(texts.values()), some)
                    added = added_spans(g, field.marginals(g), texts, base, sure)
                every = {i: sorted({*base[i], *added.get(i, [])}, key=lambda s: (LABELS.index(s[0]), *s[1:])) for i in some}
                as_rows = lambda found: pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in found.get(i, [])] for i in range(len(part))], kinds)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), as_rows(base), as_rows(every)], names=["doc_id", "base_spans", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base_spans {SPAN}, spans {SPAN}")
