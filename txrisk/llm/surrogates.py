"""Personal data replaced by keyed surrogates.

Entities are found in every text: e-mail addresses, telephone and card numbers, IP addresses, account and social
security numbers, and names that follow a form of address: all words with capitals, over initials and particles. Their words
are then found wherever else they stand in the text, and a first name before a family name that was met with its initial. A
word has one role in a text, whatever the forms of address. Names that no form of address introduces anywhere in their text
are not found. A surrogate is drawn from a keyed hash of the entity: of the
same kind and format (lengths, separators, letter case, country prefix, valid or invalid check digits), of the same
script, and for first names of the same gender, which the form of address tells. One entity has one surrogate
everywhere, however it is written; a name is kept word by word, so that a later mention by surname alone still agrees.

Two entities never share a surrogate, and no surrogate is an entity of the corpus: all distinct entities are stored
with their draw, draws that clash are found by grouping, the smaller entity keeps its draw, the others draw again, and
so on until none clash. Only those that drew again have to be told to the second scan, which replaces; all others
are drawn on the spot.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import whole
from txrisk.session import reliable

#: The key where neither the caller nor the session's KEY_SETTING gives one: for tests, as anybody can recompute what it draws.
KEY = "surrogates-1"
KEY_SETTING = "txrisk.surrogates.key"
#: Redrawn entities that are sent to every task; with more, they are joined to their documents.
MOST_SENT = 50_000
MOST_DRAWS = 40

# ---------------------------------------------------------------- fixed values
#: Forms of address: gender of the person (m, f or n) by the form in lower case, without a dot.
ADDRESS = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "herrn": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mme": "f", "mlle": "f", "señora": "f", "sra": "f",
    "señorita": "f", "srta": "f", "doña": "f",
    "dr": "n", "prof": "n", "doctor": "n", "professor": "n",
    "господин": "m", "г-н": "m", "госпожа": "f", "г-жа": "f", "κύριος": "m", "κυρία": "f",
}
#: Syllables of made-up names by script: beginnings, middles, and endings by gender and of family names.
SYLLABLES = {
    "latin": (["al", "ber", "cor", "dan", "el", "fer", "gar", "hen", "jo", "kar", "lor", "mar", "nor", "or", "per", "ros", "sel", "tor", "vi", "wal"],
              ["a", "be", "di", "e", "i", "la", "li", "mo", "ne", "o", "ra", "ri", "sa", "ti", "u", "ve"],
              {"m": ["bert", "ton", "vin", "mund", "rick", "nald"], "f": ["lina", "rissa", "nelle", "bella", "thea", "mira"],
               "n": ["ren", "lis", "dre", "kin", "ley", "rin"], "family": ["mann", "sen", "well", "ford", "son", "berg", "ley", "court"]}),
    "cyrillic": (["ал", "бо", "ва", "ген", "да", "ев", "за", "ил", "ко", "ла", "ми", "ни", "ол", "па", "ро", "се", "та", "фе"],
                 ["а", "ве", "ди", "е", "и", "ле", "мо", "ри", "са", "то"],
                 {"m": ["слав", "мир", "дан", "тон"], "f": ["лина", "рина", "слава", "мира"], "n": ["ша", "ня", "ля", "ся"],
                  "family": ["ченко", "евич", "ских", "енко", "ук"]}),
    "greek": (["αλ", "βα", "γε", "δη", "ευ", "ζη", "θε", "ιω", "κω", "λε", "μα", "νι", "πα", "στ"],
              ["α", "ε", "ι", "λα", "μο", "νι", "ρο", "τι"],
              {"m": ["νος", "ρης", "δης", "κος"], "f": ["νια", "ρα", "δα", "λη"], "n": ["νι", "λι", "κι", "ρι"],
               "family": ["ίδου", "άκη", "ούλου", "όπουλου"]}),
}
#: Words in lower case between the words of a name.
PARTICLES = frozenset("von vom van den der de del della di da do dos das du la le los las zu zum zur ter ten bin ibn al el y e i".split())
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
# ----------------------------------------------------------- end fixed values

NUMBER = r"(?<![\w.+@-])"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])\w[\w.+%-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+"),
    "ip": re.compile(NUMBER + r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w-]|\.\d)"),
    "iban": re.compile(NUMBER + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"),
    "card": re.compile(NUMBER + r"\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"),
    "ssn": re.compile(NUMBER + r"\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)"),
    "phone": re.compile(r"(?<![\w.@-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)"),
}
FORMS = sorted({form for a in ADDRESS for form in (a, a.capitalize(), a.upper())}, key=lambda a: (-len(a), a))
NAMED = re.compile(r"(?:" + "|".join(map(re.escape, FORMS)) + r")(?:\.?[ \t]+)(?=[^\W\d_])")
WORDS = re.compile(r"[^\W\d_][^\W\d_'\u2019-]*")
JOINS = ("'", "\u2019", "-")
KINDS = [*PATTERNS, "name"]


@dataclass(frozen=True)
class Found:
    begin: int
    end: int
    kind: str  # for names: first-m, first-f, first-n or family, each with the script
    entity: str


def script(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
    return "latin"


def normal(kind: str, surface: str) -> str:
    """What all ways to write an entity have in common."""
    if kind in ("email", "name"):
        return surface.lower()
    if kind == "ip":
        return surface
    head = "+" if kind == "phone" and surface[0] == "+" else ""
    return head + "".join(c for c in surface if c.isalnum())


def people(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """Gender, words and initials of every name after a form of address: all words with capitals that follow, over particles and
    initials. Where all is in capitals they mark no names, so two words are taken."""
    for m in NAMED.finditer(text):
        form = m[0].rstrip(" \t").rstrip(".")
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        words, initials, at = [], [], m.end()
        while w := WORDS.match(text, at):
            if w[0][0].isupper():
                if len(w[0]) == 1 and text[w.end():w.end() + 1] == ".":
                    initials.append(w[0].lower())
                    at = w.end() + 1
                else:
                    if len(w[0]) > 1:
                        words.append((w.start(), w.end()))
                    at = w.end()
                    if text[at:at + 1] in JOINS and text[at + 1:at + 2].isupper():
                        at += 1  # the next part of a name with a hyphen or an apostrophe
                        continue
                    if len(words) == 2 and form.isupper() and len(form) > 1 and all(text[x:y].isupper() for x, y in words):
                        break
            elif w[0] in PARTICLES:
                at = w.end()
            else:
                break
            begin = at
            while at < len(text) and text[at] in " \t":
                at += 1
            if at == begin:
                break
        if words:
            yield ADDRESS[form.lower()], words, initials


def single_words(text: str) -> Iterator[tuple[int, int]]:
    """Words with a capital; a hyphen or an apostrophe ends a word."""
    for w in WORDS.finditer(text):
        if w.start() and (text[w.start() - 1].isalnum() or text[w.start() - 1] == "_") or text[w.end():w.end() + 1].isalnum() or text[w.end():w.end() + 1] == "_":
            continue
        if w[0][0].isupper():
            yield w.start(), w.end()


def named(text: str) -> Iterator[tuple[int, int, str]]:
    """Begin, end and role (first-m, first-f, first-n or family) of the words of names in a text. A word has one role there: if any
    name has it before its last word, it is a first name. Words of names are also found where they stand alone later or earlier,
    and so is a first name before a family name that was met with its initial."""
    roles: dict[str, str] = {}
    short: dict[tuple[str, str], str] = {}  # family name, initial -> gender
    for gender, words, initials in people(text):
        for i, (begin, end) in enumerate(words):
            word, role = text[begin:end].lower(), "family" if i == len(words) - 1 else f"first-{gender}"
            before = roles.get(word)
            if before is None or before == "family" or before == "first-n" and role != "family":
                roles[word] = role if before is None or role != "family" else before
        family_name = text[slice(*words[-1])].lower()
        short.update({(family_name, c): gender for c in initials})
    if not roles:
        return
    if short:
        last = None
        for begin, end in single_words(text):
            if last and text[last[1]:begin].strip(" \t") == "" and last[1] < begin:
                gender = short.get((text[begin:end].lower(), text[last[0]].lower()))
                if gender and last[1] - last[0] > 1:
                    roles.setdefault(text[last[0]:last[1]].lower(), f"first-{gender}")
            last = begin, end
    for begin, end in single_words(text):
        if role := roles.get(text[begin:end].lower()):
            yield begin, end, role


def entities(text: str | None) -> list[Found]:
    """The entities of a text, left to right, none over another; of two that overlap the one of the kind listed first."""
    text = text or ""
    out: list[Found] = []
    digits = any(c in text for c in "0123456789")
    begins: list[int] = []
    ends: list[int] = []

    def put(begin: int, end: int, kind: str, entity: str) -> None:
        at = bisect.bisect_right(begins, begin)
        if (at and ends[at - 1] > begin) or (at < len(begins) and begins[at] < end):
            return
        begins.insert(at, begin)
        ends.insert(at, end)
        out.append(Found(begin, end, kind, entity))

    for kind, pattern in PATTERNS.items():
        if ("@" in text) if kind == "email" else digits:
            for m in pattern.finditer(text):
                put(m.start(), m.end(), kind, normal(kind, m[0]))
    for begin, end, role in named(text):
        put(begin, end, f"{role}-{script(text[begin:end])}", text[begin:end].lower())
    return sorted(out, key=lambda f: f.begin)


def stream(key: str, *parts: str) -> Iterator[int]:
    """Bytes that only the key and the parts determine."""
    name = "\x1f".join(parts).encode("utf-8", "surrogatepass")
    block = 0
    while True:
        yield from hashlib.blake2b(name + block.to_bytes(4, "little"), key=key.encode()[:64], digest_size=64).digest()
        block += 1


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def alike(text: str, draw: Iterator[int]) -> str:
    """Letters become letters of their script, digits digits (a first one that is not zero stays so)."""
    out = []
    for i, c in enumerate(text):
        if c.isdigit():
            b = next(draw) * 256 + next(draw)
            out.append(str(1 + b % 9) if i == 0 and c != "0" else str(b % 10))
        elif c.isalpha():
            letters = LETTERS[script(c)]
            b = letters[(next(draw) * 256 + next(draw)) % len(letters)]
            out.append(b.upper() if c.isupper() else b)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: str, kind: str, entity: str, turn: int = 0) -> str:
    """The normal form of an entity's surrogate at its ``turn``-th draw."""
    draw = stream(key, kind, entity, str(turn))
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        host, dot, top = domain.rpartition(".")
        # A domain has one surrogate for all its addresses.
        made = alike(local, draw) + "@" + alike(host, stream(key, "domain", domain, str(turn // 8))) + dot + top
        return made
    if kind == "ip":
        octets = [next(draw) for _ in range(4)]
        old = entity.split(".")
        keep = 1 if old[0] == "10" else 2 if entity.startswith("192.168.") else 0
        return ".".join(old[:keep] + [str(1 + x % 254) if i in (0, 3) else str(x) for i, x in enumerate(octets)][keep:])
    if kind == "card":
        made = alike(entity, draw)
        for last in range(10):
            # Valid numbers stay valid, others invalid.
            if luhn(made[:-1] + str((int(made[-1]) + last) % 10)) == luhn(entity):
                return made[:-1] + str((int(made[-1]) + last) % 10)
    if kind == "phone":
        # The country stays: one digit for +1 and +7, else two.
        head = 0 if entity[0] != "+" else 2 if entity[1] in "17" else 3
        return entity[:head] + alike(entity[head:], draw)
    if kind == "iban":
        return entity[:2] + alike(entity[2:], draw)
    if kind == "ssn":
        return alike(entity, draw)
    role, _, writing = kind.rpartition("-")
    first, middle, last = SYLLABLES[writing]
    last = last["family" if role == "family" else role[-1]]
    # Every fourth draw adds a syllable: there are always enough names.
    parts = [first[next(draw) % len(first)], *[middle[next(draw) % len(middle)] for _ in range(1 + turn // 4)], last[next(draw) % len(last)]]
    return "".join(parts)


def written(kind: str, surface: str, made: str) -> str:
    """The surrogate in the way that the entity was written here."""
    if kind in ("email", "ip"):
        if len(made) == len(surface):
            return "".join(m.upper() if c.isupper() else m for c, m in zip(surface, made))
        return made
    if kind in PATTERNS:
        rest = iter(made.removeprefix("+"))
        return "".join(next(rest) if c.isalnum() else c for c in surface)
    return made.upper() if len(surface) > 1 and surface.isupper() else made[0].upper() + made[1:]


def replaced(text: str | None, key: str, turns: dict[tuple[str, str], int]) -> tuple[str, list[Found]]:
    found = entities(text)
    if not found:
        return text or "", found
    out, at = [], 0
    for f in found:
        out += [text[at:f.begin], written(f.kind, text[f.begin:f.end], surrogate(key, f.kind, f.entity, turns.get((f.kind, f.entity), 0)))]
        at = f.end
    return "".join(out) + text[at:], found


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mark, kind, entity), once for each document and entity."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(whole(text)).alias("mark"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, names = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                for kind, entity in dict.fromkeys((f.kind, f.entity) for f in entities(t)):
                    at.append(i)
                    kinds.append(kind)
                    names.append(entity)
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), pa.array(kinds, pa.string()),
                                              pa.array(names, pa.string())], names=["key", "mark", "kind", "entity"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, mark bigint, kind string, entity string")


def family(kind: str):
    """Kinds whose surrogates must differ from each other: a first name may not become another's first name."""
    return F.when(F.col(kind).startswith("first-"), F.lit("first")).when(F.col(kind).startswith("family-"), F.lit("family")).otherwise(F.col(kind))


def drawn(table: DataFrame, secret: str) -> DataFrame:
    """(kind, entity, turn) -> with the surrogate of that turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("kind", "entity", "turn")])
            made = pa.array([surrogate(secret, k, e, t) for k, e, t in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "entity", "turn")], made], names=["kind", "entity", "turn", "surrogate"])

    return table.select("kind", "entity", "turn").mapInArrow(run, "kind string, entity string, turn int, surrogate string")


def assigned(found: DataFrame, secret: str = KEY) -> DataFrame:
    """(kind, entity, turn, surrogate) for every distinct entity, without clashes; stored."""
    table = reliable(drawn(found.select("kind", "entity").distinct().withColumn("turn", F.lit(0)), secret))
    for _ in range(MOST_DRAWS):
        named = table.withColumn("family", family("kind"))
        holders = named.groupBy("family", "surrogate").agg(
            F.min(F.struct("turn", "kind", "entity")).alias("holder"))
        real = named.select("family", F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        judged = named.join(holders, ["family", "surrogate"]).join(real, ["family", "surrogate"], "left")
        mine = (F.col("holder.kind") == F.col("kind")) & (F.col("holder.entity") == F.col("entity"))
        clash = F.col("real").isNotNull() | ~mine
        judged = reliable(judged.select("kind", "entity", "turn", "surrogate", clash.alias("clash")))
        again = judged.filter("clash")
        if again.isEmpty():
            return judged.drop("clash")
        fresh = drawn(again.select("kind", "entity", (F.col("turn") + 1).alias("turn")), secret)
        table = reliable(judged.filter("NOT clash").drop("clash").unionByName(fresh))
    raise RuntimeError(f"surrogates still clash after {MOST_DRAWS} draws")


def replaced_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: str | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """One row per row of ``docs``: key, text with surrogates, and the number of entities of every kind.

    A missing text is empty. Rows that repeat each other get equal texts; rows without a key are treated like any. No
    rows give no rows. Other columns may have any name.
    """
    secret = secret or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    found = reliable(mentions(docs, key, text))
    moved = assigned(found, secret).filter("turn > 0").select("kind", "entity", "turn")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    count = moved.count()
    sent = {}
    if count <= most_sent:
        sent = {(r.kind, r.entity): r.turn for r in moved.collect()}
        rows = rows.withColumn("turns", F.lit(None).cast("array<struct<kind:string,entity:string,turn:int>>"))
    else:
        per = found.join(moved, ["kind", "entity"]).groupBy("key", "mark").agg(F.collect_set(F.struct("kind", "entity", "turn")).alias("turns"))
        per = per.withColumnsRenamed({"key": "_key", "mark": "_mark"}).hint("shuffle_hash")
        on = F.col("key").eqNullSafe(F.col("_key")) & (F.xxhash64(whole("text")) == F.col("_mark"))
        rows = rows.join(per, on, "left").select("key", "text", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for t, turns in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = {(x["kind"], x["entity"]): x["turn"] for x in turns} if turns else sent
                made, hits = replaced(t, secret, own)
                out.append(made)
                n = dict.fromkeys(KINDS, 0)
                for f in hits:
                    n[f.kind if f.kind in PATTERNS else "name"] += 1
                counts.append(list(n.values()))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), *columns], names=["key", "text", *[f"n_{k}" for k in KINDS]])

    kind = docs.schema[key].dataType.simpleString()
    made = rows.mapInArrow(run, f"key {kind}, text string, " + ", ".join(f"n_{k} bigint" for k in KINDS))
    return made.withColumnRenamed("key", key)
