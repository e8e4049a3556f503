"""Personal data: candidate spans, boosted trees over format and context, and calibrated thresholds.

Spans of the base kinds (email, ip, card, phone) are exact patterns with checks and always stay. Beyond them, generators with a
high recall propose overlapping candidates: around digits, secrets (long mixed runs), national numbers, bank account numbers, phone numbers
without a country sign, and dates of birth; and after a word that names one and a sign of assignment, secrets with or without digits. Boosted trees score each from its format and the words around it; they are trained here, on
spans written by templates in code, and the threshold of each kind is the least calibrated probability that keeps PRECISION on templates
that were not fitted. Of accepted candidates that overlap, the likeliest stays; none may overlap a base span.

Places are code points, ends exclusive. Defined cases: a null or empty text has no spans; repeated rows are scored alike; an empty table
gives no rows; columns other than doc_id and text are ignored or, in redacted(), kept.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import bound_batches, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "birth", "national", "secret", "telephone")
PRECISION = 0.98

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Tried once for a run of digits: what follows a run is the same from all of its places, and matches end where runs do.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches of an address: each holds one @, so every @ is tried once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(at_most_255(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: Generators: a pattern matched around a digit. They overlap on purpose.
GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+=-]{16,}"),
    "national": re.compile(r"(?<![0-9.-])[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "telephone": re.compile(r"(?<![0-9.+])\(?0?[0-9]{2,4}\)?[ ./-]?[0-9]{3,4}[ ./-]?[0-9]{3,5}(?![0-9-])"),
    "birth": re.compile(r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"),
}
#: What a secret is made of: windows never end within a run of it.
RUN = re.compile(r"[A-Za-z0-9_/+=-]+")
RUN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+=-")
#: Words that stand near such data, by kind: fixed values.
CONTEXT = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "bearer", "auth", "credential"),
    "national": ("ssn", "social", "security", "national", "passport", "identity", "insurance", "id"),
    "account": ("iban", "account", "bank", "konto", "compte", "cuenta", "swift", "bic"),
    "telephone": ("phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "teléfono", "portable", "contact"),
    "birth": ("born", "birth", "birthday", "dob", "geboren", "né", "née", "nacido", "nacida"),
}
#: A secret by what stands before it: a naming word, = or :, perhaps a quotation mark.
NAMED = re.compile(r"(?:token|secret|password|passwd|pwd|api[_-]?key|credential)[\"'`]?[ \t]{0,4}[:=][ \t]{0,4}[\"'`]?([^\s\"'`<>,;\x5b\x5d(){}]{6,})", re.I)
WORD = re.compile(r"[^\W\d]+")


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return len(s) > 4 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span, and the words within 40 characters before and 20 after."""
    s = text[start:end]
    n = len(s)
    digits, upper, lower = sum(c.isdigit() for c in s), sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    near = [w.lower() for w in WORD.findall(before)][-4:]
    told = CONTEXT[kind]
    mark = before.rstrip(" \"'`")[-1:]
    hexadecimal = all(c in "0123456789abcdef" for c in s.lower())
    check = {"national": lambda: s[:3] not in ("000", "666") and s[0] != "9", "account": lambda: iban_ok(s)}.get(kind, lambda: False)()
    return [n, digits / n, upper / n, lower / n, entropy, changes / n, len(set(c for c in s if not c.isalnum())), hexadecimal, check, mark in "=:" and mark != "", any(w in told for w in near), any(w in told for w in near[-1:]), any(w.lower() in told for w in WORD.findall(after)[:2]), s[:1].isdigit(), before[-1:] in "\"'`" and after[:1] in "\"'`" and before[-1:] != ""]


def templates(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, start, end, label): written spans of personal data, and spans that only look like them."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    letters = "abcdefghijklmnopqrstuvwxyz"
    alnum = lambda k: "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))

    def iban() -> str:
        country, body = rng.choice(["DE", "FR", "ES", "GB"]), digits(rng.choice([14, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    def secret() -> str:
        kinds = [lambda: hexes(rng.choice([32, 40, 64])), lambda: alnum(rng.randrange(20, 60)), lambda: rng.choice(["sk-", "ghp_", "AKIA", "key-"]) + alnum(rng.randrange(16, 40)), passphrase]
        return rng.choice(kinds)()

    def passphrase() -> str:
        return rng.choice(["", "-", "_", "."]).join(word() + word() for _ in range(rng.randrange(2, 5))) + rng.choice(["", "!", digits(2), digits(4)])

    make = {
        "secret": (secret, lambda: rng.choice([f"{word()}-{word()}-{digits(4)}-{word()}", f"{word()}{word()}{word()}{digits(2)}", f"{word()}/{word()}/{digits(4)}/{word()}-{word()}", digits(20), hexes(40)])),
        "national": (lambda: f"{rng.randrange(100, 600)}-{digits(2)}-{digits(4)}", lambda: rng.choice([digits(9), f"{digits(3)} {digits(2)} {digits(4)}"])),
        "account": (iban, lambda: rng.choice(["AB", "XR", "NO"]) + digits(2) + " " + digits(4) + " " + digits(4)),
        "telephone": (lambda: rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]), lambda: rng.choice([digits(10), f"{digits(4)}-{digits(4)}", f"{digits(3)}/{digits(3)}/{digits(3)}"])),
        "birth": (lambda: f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1930, 2015)}", lambda: f"{rng.randrange(1990, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}"),
    }
    out = []
    for _ in range(n):
        kind = rng.choice(ADDED)
        label = rng.randrange(2)
        # data stands after a word that names it, or is a secret or account by its format; look-alikes stand in plain text
        told = label and (kind in ("telephone", "birth", "national") or rng.random() < 0.7)
        before = " ".join(word() for _ in range(rng.randrange(0, 5)))
        if told:
            before += " " + word()
            before = f"{before} {rng.choice(CONTEXT[kind])}" + rng.choice([" = ", ": ", " ", "=", ' "', ' = "'])
        elif before:
            before += " "
        span = make[kind][1 - label]() if label or rng.random() < 0.6 else make[kind][0]()
        if not label and kind in ("secret", "account"):
            span = make[kind][1]()
        if label and not told and kind == "secret":
            span = rng.choice(["sk-", "ghp_", "AKIA"]) + alnum(rng.randrange(24, 40))
        if label and kind == "secret" and told and not any(c.isdigit() for c in span):
            before = f"{before.rstrip(' =:')}{rng.choice([' = ', ': ', '='])}" if before[-1:] == " " and before.rstrip()[-1:] not in "=:" else before
        text = before + span + rng.choice(["", ".", ", ", '"', " "]) + " ".join(word() for _ in range(3))
        out.append((kind, text, len(before), len(before) + len(span), label))
    return out


@lru_cache(maxsize=1)
def model(n: int = 3000, seed: int = 11) -> tuple[dict[str, BoostedTrees], dict[str, float]]:
    """For each added kind its trees and threshold, trained from templates: the same ones on every worker."""
    fitted, held = templates(n, seed), templates(n, seed + 1)
    trees, least = {}, {}
    for kind in ADDED:
        x, y = (np.array([v for v in c], float) for c in zip(*[(features(*r[:4]), r[4]) for r in fitted if r[0] == kind], strict=True))
        hx, hy = (np.array([v for v in c], float) for c in zip(*[(features(*r[:4]), r[4]) for r in held if r[0] == kind], strict=True))
        half = np.arange(len(hy)) % 2 == 0
        trees[kind] = BoostedTrees().fit(x, y).calibrate(hx[half], hy[half])
        p, truth = trees[kind].probability(hx[~half]), hy[~half]
        least[kind] = next((float(c) for c in np.linspace(0.5, 0.99, 50) if truth[p >= c].size and truth[p >= c].mean() >= PRECISION), 1.1)
    return trees, least


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of all generators, found around the digits of a text only."""
    out, done = [], 0
    windows = []
    for m in DIGIT.finditer(text):
        at = m.start()
        if at < done:
            continue
        lo = max(0, at - 220)
        lo = text.rfind("\n", lo, at) + 1 if text.rfind("\n", lo, at) >= 0 else lo
        end = text.find("\n", at)
        hi = min(len(text) if end < 0 else end, at + 220)
        free = windows[-1][1] if windows else 0
        while lo > free and text[lo - 1] in RUN_CHARACTERS:
            lo -= 1
        run = RUN.match(text, hi)
        hi = run.end() if run else hi
        if windows and lo <= windows[-1][1]:
            windows[-1] = (windows[-1][0], max(hi, windows[-1][1]))
        else:
            windows.append((lo, hi))
        done = max(at + 1, hi - 210)
    for kind, pattern in GENERATORS.items():
        for lo, hi in windows:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text, lo, hi)]
    return out


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    proposed = candidates(text) if DIGIT.search(text) else []
    if ":" in text or "=" in text:
        proposed = sorted({*proposed, *(("secret", m.start(1), m.end(1)) for m in NAMED.finditer(text))})
    if not proposed:
        return []
    trees, least = model()
    scored = []
    for kind in ADDED:
        own = [s for s in proposed if s[0] == kind]
        if own:
            p = trees[kind].probability(np.array([features(k, text, a, b) for k, a, b in own], float))
            scored += [(-q, a, b, kind) for q, (_, a, b) in zip(p.tolist(), own, strict=True) if q >= least[kind]]
    taken, out = [(a, b) for _, a, b in base], []
    for _, a, b, kind in sorted(scored):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


ORDER = {k: n for n, k in enumerate(BASE + ADDED)}


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ORDER[s[0]], s[1], s[2])))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, a count of each base kind, base_sha256, all spans and their number of every row of docs."""
    bound_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, spans, many = [], [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                counts.append([sum(k == kind for k, _, _ in base) for kind in BASE])
                sums.append(hashlib.sha256(written(base).encode()).hexdigest())
                every = base + added_spans(text or "", base)
                spans.append(written(every))
                many.append(len(every))
            columns = list(zip(*counts, strict=True)) or [()] * len(BASE)
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(many, pa.int64())], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def replaced(text: str | None) -> str | None:
    """A text with every span replaced by its kind in brackets; of spans that overlap, one name stands for all."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base + added_spans(text, base)):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """docs with its texts redacted; n_chars, where there is one, is counted anew."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(replaced, na_action="ignore")

    # a null stays a null
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_personal_data(table(spark, sf_dir, "documents"))
