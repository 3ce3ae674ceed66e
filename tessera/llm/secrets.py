"""Secret scans by assignment-aware lexing.

Two layers over every whole text:

* base patterns: ``assign`` (keyword, separator, value), ``access`` (access
  key ids) and ``hex`` (long hexadecimal runs), leftmost non-overlapping per
  kind, matches that are too short dropped;
* a lexer for source and configuration syntax that reads name-literal pairs
  (``name = "x"``, ``name: x``, ``"name" => 'x'``, ``NAME=x``,
  ``<name>x</name>``, ``name("x")``, ``set("name", "x")``, triple-quoted
  strings, YAML block scalars, literals joined by ``+`` or ``.``, with or
  without blanks and across lines), propagates constants (``k = "x"`` then
  ``password = k`` makes the literal ``x`` a password; all parts of a constant
  count, however many) and scores each literal by how sensitive its target names
  are and how random it looks. Literals that pass and touch no base span are
  added as ``literal``. Names have one scope, the text; comments are read like
  code, since secrets are left in both.

A span has code-point offsets, end exclusive; ``value_start``/``value_end``
enclose the secret itself, which ``redact`` replaces.

Defined results: a null text is empty and has no spans; rows are mapped one to
one, so repeated rows and extra columns need no rule; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

KINDS = ["assign", "access", "hex", "literal"]
#: Shortest value of each base kind.
LEAST = {"assign": 12, "access": 18, "hex": 16}
SPANS = ("array<struct<kind:string,start:int,end:int,value_start:int,value_end:int,name:string,score:double>>")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ["password", "passwd", "secret", "token"])) + "|" + _either_case("api") + "_?" + _either_case("key")
_ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 and more


def base_spans(text: str) -> list[dict]:
    out = []
    if "=" in text or ":" in text:  # an assignment has one of them
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append(_span("assign", m.start(), m.end(), m.start(2), m.end(2), m[1], 1.0))
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST["access"]:
            out.append(_span("access", m.start(), m.end(), m.start(), m.end(), "", 1.0))
    for m in _HEX.finditer(text):
        out.append(_span("hex", m.start(), m.end(), m.start(), m.end(), "", 1.0))
    return out


def _span(kind, start, end, value_start, value_end, name, score) -> dict:
    return {"kind": kind, "start": start, "end": end, "value_start": value_start, "value_end": value_end,
            "name": name, "score": score}


# --- the lexer -----------------------------------------------------------------

_TRIPLE = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
_STRING = _TRIPLE + r'|"(?:[^"\\\n]|\\.)*+"|' + r"'(?:[^'\\\n]|\\.)*+'|" + r"`[^`\n]*+`"
_NAME = r"[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+"
#: A name begins where no longer one does, so that long runs are read once.
_BEGIN = r"(?<![\w$])(?<![\w$][.\-])"
#: name (perhaps quoted or subscripted), separator (perhaps with a type), and the start of a value
_PAIR = re.compile(rf"""{_BEGIN}(?P<q>["'`]?)(?P<name>{_NAME})(?P=q)\]?(?:\x20|\t)*+(?P<sep>:[\x20\t]*+(?P<type>{_NAME})(?:\[[^\]\n]{{0,80}}\])?[\x20\t]*+=(?![=>])|:=|=>|(?<![=!<>])=(?!=)|:(?![:/]))(?:\x20|\t)*+(?:\([\x20\t\n]*+(?=["'`]))?(?P<value>{_STRING}|[^\s"'`,;(){{}}<>\[\]]++)""")
_ELEMENT = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\n]+)</(?P=name)>")
#: name("x"), and a call or a list with "name", "x"
_CALL = re.compile(rf"{_BEGIN}(?P<name>{_NAME})\((?:\x20|\t)*+(?P<value>{_STRING})(?=(?:\x20|\t)*+\))")
_ARGUMENTS = re.compile(rf"""[(\[,](?:\x20|\t)*+(?P<q>["'])(?P<name>{_NAME})(?P=q)(?:\x20|\t)*+,(?:\x20|\t)*+(?P<value>{_STRING})""")
#: name: | and the lines that are indented deeper
_BLOCK = re.compile(rf"""^(?P<indent>[\x20\t]*+)(?:-[\x20\t]++)?(?P<q>["']?)(?P<name>{_NAME})(?P=q)[\x20\t]*+:[\x20\t]*+[|>][+\-0-9]{{0,2}}[\x20\t]*+\n""", re.M)
#: further operands of a joined value: after an operator, or (strings) on their own line
_MORE = re.compile(rf"(?:\s|\\\n)*+(?:\+(?:\s|\\\n)*+(?P<value>{_STRING}|{_NAME})|\.(?:\s|\\\n)*+(?P<string>{_STRING})|\.(?:\x20|\t)++(?P<other>{_NAME}))")
_IDENTIFIER = re.compile(rf"{_NAME}\Z")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How much a word of a name says that its value is secret; negative words take it back.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "pass": 2, "passphrase": 3, "secret": 3, "secrets": 3, "token": 3,
             "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "bearer": 2, "private": 2, "signing": 2,
             "encryption": 2, "access": 1, "api": 1, "key": 2, "salt": 1,
             "count": -3, "max": -3, "min": -3, "limit": -3, "name": -3, "file": -3, "path": -3, "url": -3, "uri": -3,
             "public": -3, "hint": -3, "label": -3, "length": -3, "type": -3, "expires": -3, "id": -1}
_PLACEHOLDER = re.compile(r"\$\{|\{\{|%\(|<|changeme|example|placeholder|your[_-]|dummy|redacted|(.)\1{5}|1234567", re.I)
#: Score of name and literal together from which a literal counts as a secret.
ENOUGH = 5.0


def name_score(name: str) -> int:
    return sum(SENSITIVE.get(w.lower(), 0) for w in _WORDS.findall(name))


class Parts:
    """What the score needs of literals joined in any number."""

    def __init__(self, text: str = ""):
        self.counts, self.n = Counter(text), len(text)
        self.placeholder = bool(_PLACEHOLDER.search(text))

    def add(self, other: Parts) -> None:
        self.counts.update(other.counts)
        self.n += other.n
        self.placeholder |= other.placeholder

    def score(self) -> float:
        """Up to 4: length, entropy, digits among letters, no blanks; below 0 for placeholders."""
        n = self.n
        if n < 8 or self.placeholder:
            return -9.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        mixed = any(map(str.isdigit, self.counts)) and any(map(str.isalpha, self.counts))
        return (n >= 12) + (entropy >= 3.0) + mixed + (not any(map(str.isspace, self.counts)))


def literal_score(value: str) -> float:
    return Parts(value).score()


class Value:
    """What a name holds: its own literals and the values of the names it uses (shared, not copied)."""

    def __init__(self, literals: list[tuple[int, int, str]], used: list[Value]):
        self.literals, self.used, self.parts = literals, used, Parts()
        for _, _, text in literals:
            self.parts.add(Parts(text))
        for value in used:
            self.parts.add(value.parts)
        self.seen: list[tuple[int, float]] = []  # (name score, joined score) it was visited with


def _literal(raw: str, at: int) -> tuple[int, int, str] | None:
    """(start, end, text) of a value that is a literal; None for an identifier."""
    if raw[0] in "\"'`":
        width = 3 if len(raw) >= 6 and raw[:3] in ('"""', "'''") else 1
        return (at + width, at + len(raw) - width, raw[width:-width]) if len(raw) > 2 * width else None
    return None


def _block_end(text: str, at: int, indent: str) -> int:
    """Where the lines deeper than ``indent`` (or blank) from ``at`` on end."""
    end = at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        if line.strip():
            if not line.startswith(indent) or not line[len(indent):len(indent) + 1].isspace():
                break
            end = stop
        at = stop + 1
    return end


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int, str]], list[str], tuple[int, int]]]:
    """(target name, literals, identifiers used, extent of the statement) in text order."""
    found = [(m.start(), m) for p in (_PAIR, _ELEMENT, _CALL, _ARGUMENTS) for m in p.finditer(text)]
    found += [(m.start("name"), m) for m in _BLOCK.finditer(text)]
    read = 0
    for start, m in sorted(found, key=lambda x: x[0]):
        name, literals, used, end = m["name"], [], [], m.end()
        if m.re is _BLOCK:
            if start < read:  # a header inside a block that is read
                continue
            at, end = m.end(), _block_end(text, m.end(), m["indent"])
            read = end
            block = text[at:end]
            if block.strip():
                at += len(block) - len(block.lstrip())
                literals.append((at, end, "".join(block.split()) if "\n" in block.strip() else block.strip()))
        elif m.re is _ELEMENT:
            literals.append((m.start("value"), end - len(name) - 3, m["value"]))
        else:
            part, group = m, "value"
            if m.re is _PAIR and m["type"] and name_score(m["type"]) > name_score(name):
                name = m["type"]  # "note: password = x" rather than a type
            while part is not None:
                raw, at, end = part[group], part.start(group), part.end()
                if lit := _literal(raw, at):
                    literals.append(lit)
                elif _IDENTIFIER.match(raw):
                    used.append(raw)
                    if part is m and any(c.isdigit() for c in raw):
                        literals.append((at, end, raw))  # a bare configuration value may look like a name
                elif part is m:
                    literals.append((at, end, raw))
                if part := _MORE.match(text, end):
                    group = part.lastgroup
        yield name, literals, used, (start, end)


def literal_spans(text: str) -> list[dict]:
    """Literals whose target names, direct or through constants, are sensitive enough."""
    if not any(c in text for c in ("=", ":", "</", "(")):
        return []
    constants: dict[str, Value] = {}
    best: dict[tuple[int, int], dict] = {}
    for name, literals, used, (start, end) in pairs(text):
        value = Value(literals, [constants[u] for u in dict.fromkeys(used) if u in constants])
        if (sensitive := max(name_score(name), 0)) >= 2:
            joined, waiting = value.parts.score(), [value]
            while waiting:
                one = waiting.pop()
                if any(s >= sensitive and j >= joined for s, j in one.seen):
                    continue  # nothing in it can score more than before
                one.seen.append((sensitive, joined))
                waiting += one.used
                for a, b, part in one.literals:
                    score = sensitive + max(literal_score(part), joined)
                    if score >= ENOUGH and b > a and score > best.get((a, b), {"score": 0})["score"]:
                        direct = start <= a and b <= end
                        best[a, b] = _span("literal", start if direct else a, end if direct else b, a, b, name, float(score))
        constants[name] = value  # what later statements may refer to
    return list(best.values())


def find_secrets(text: str) -> list[dict]:
    """All spans of a text by start, then kind."""
    base = base_spans(text)
    taken = sorted((s["start"], s["end"]) for s in base)
    extra = []
    for s in sorted(literal_spans(text), key=lambda s: (s["value_start"], s["value_end"])):
        if not any(a < s["end"] and s["start"] < b for a, b in taken):
            extra.append(s)
    return sorted(base + extra, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def redact(text: str, spans: list[dict]) -> str:
    """The text with every secret value replaced by a mark of its kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["value_start"], -s["value_end"])):
        if s["value_end"] <= at:
            continue
        if s["value_start"] >= at:
            out += [text[at:s["value_start"]], f"<redacted:{s['kind']}>"]
        at = s["value_end"]
    return "".join(out) + text[at:]


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()),
                             ("value_end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans (sorted array of structs) of every row."""
    kind = dict(documents.dtypes)[id_column]

    def spans(batches):
        for batch in batches:
            found = [find_secrets(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _ARROW)], ["doc_id", "spans"])

    return (documents.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
            .mapInArrow(spans, f"doc_id {kind}, spans {SPANS}"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_documents(documents: DataFrame, text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """``documents`` with secret values in the texts replaced (null texts stay null);
    ``length_column``, if given, is set to the new number of characters."""
    names, at = documents.columns, documents.columns.index(text_column)

    def clean(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            done = [t and redact(t, found) if (found := find_secrets(t or "")) else t for t in texts]
            yield batch.set_column(at, names[at], pa.array(done, pa.string()))

    out = documents.mapInArrow(clean, documents.schema)
    if length_column in names:
        out = out.withColumn(length_column, F.length(text_column).cast(dict(documents.dtypes)[length_column]))
    return out
