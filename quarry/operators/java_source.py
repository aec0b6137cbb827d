"""Java source files read into classes, methods and what is known of them.

A file is cut into tokens; types and members are read by their brackets, bodies stay
token runs from which calls, key statements, complexity and structure are taken. Files
are independent rows, so reading is one map over Arrow batches; everything after it is
column expressions over the nested rows.

A null or empty file gives no rows. What cannot be read to its end is taken as far as it
goes; a file on which reading fails gives one row with the error and no name. Types of
calls are resolved by the declared types of fields, parameters and locals, by imports
and by the package; a call on a longer chain has no target.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|\.\.\.|&&|\|\||[=!<>+*/%&|^-]=|\+\+|--|\S', re.S)
_MODIFIERS = frozenset("public protected private static final abstract synchronized native transient volatile strictfp default sealed".split())
_TYPES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD", "@interface": "ANNOTATION"}
_NO_CALL = frozenset("if for while switch catch synchronized return throw new super this try assert do else case instanceof".split())
_STRUCTURE = {"if": "IF", "while": "WHILE", "do": "DO", "switch": "SWITCH", "try": "TRY", "catch": "CATCH", "return": "RETURN", "throw": "THROW", "break": "BREAK", "continue": "CONTINUE", "synchronized": "SYNC"}
_OPEN, _CLOSE = {"(": ")", "{": "}", "[": "]"}, frozenset(")}]")


@dataclass(slots=True)
class Token:
    text: str
    line: int
    at: int
    comment: str = ""


@dataclass
class Heads:
    """What stands before a declaration."""

    modifiers: list[str] = field(default_factory=list)
    annotations: list[dict[str, str]] = field(default_factory=list)


def tokens(text: str) -> list[Token]:
    """All tokens but comments, which belong to the token after them."""
    out, line, comment, ends = [], 1, "", text.find("\n")
    for m in _TOKEN.finditer(text):
        word, at = m[0], m.start()
        while -1 < ends < at:
            line, ends = line + 1, text.find("\n", ends + 1)
        if word.startswith(("//", "/*")):
            comment = word
        else:
            out.append(Token(word, line, at, comment))
            comment = ""
    return out


def said(run: list[Token]) -> str:
    """A token run as text: words apart, blanks round operators and behind commas, none elsewhere."""
    out, apart, before = "", False, ""
    for t in run:
        word = t.text
        round_ = word in _SPACED or word in ("<", ">") and _VALUE(before) is not None
        if before and (apart or round_ or _WORDLIKE(word) and _BEFORE_WORD(before) or before == "," or word == "{" or before == "{"):
            out += " "
        out, apart, before = out + word, round_, word
    return out


_SPACED = frozenset("= == != >= <= && || + - * / % ? : -> += -= *= /=".split())
#: What stands before a comparison and not before type arguments: names of values, constants, numbers, brackets.
_VALUE = re.compile(r"[a-z_]\w*$|[A-Z][A-Z0-9_]+$|\d|\)$").match
_WORDLIKE, _BEFORE_WORD = re.compile(r"[\w$\"']").match, re.compile(r"[\w$\"'\])]").match
_IN_NAME, _NAME, _BEFORE_CALL, _TYPE_NAME = re.compile(r"[\w$]").match, re.compile(r"[A-Za-z_$]").match, re.compile(r"[\w$)\]]").match, re.compile(r"(?:[a-z]\w*\.)*[A-Z]\w*").fullmatch


def summary(comment: str) -> str:
    """The first sentence of a comment, else its first line."""
    bare = re.sub(r"^/\*+|\*+/$|^//", "", comment.strip())
    lines = [re.sub(r"^\s*\*?\s?", "", x).strip() for x in bare.split("\n")]
    clean = "\n".join(x for x in lines if x and not x.startswith("@"))
    dot = clean.find(". ")
    return clean[: dot + 1] if dot > 0 else clean.split("\n", 1)[0]


class Reader:
    def __init__(self, text: str):
        self.text, self.run, self.k = text, tokens(text), 0
        self.package, self.imports, self.rows = "", [], []

    def peek(self, ahead: int = 0) -> str:
        return self.run[self.k + ahead].text if self.k + ahead < len(self.run) else ""

    def group(self) -> list[Token]:
        """The tokens inside the bracket group that begins here; the reader stands behind it."""
        depth, start = 0, self.k + 1
        while self.k < len(self.run):
            t = self.run[self.k].text
            depth += (t in _OPEN) - (t in _CLOSE)
            self.k += 1
            if depth == 0:
                return self.run[start : self.k - 1]
        return self.run[start:]

    def name(self) -> str:
        """A dotted name."""
        out = self.peek()
        self.k += 1
        while self.peek() == "." and (_IN_NAME(self.peek(1)) or self.peek(1) == "*"):
            out += "." + self.peek(1)
            self.k += 2
        return out

    def angled(self) -> str:
        """A group of type arguments, if one begins here, as text."""
        if self.peek() != "<":
            return ""
        depth, start = 0, self.k
        while self.k < len(self.run):
            depth += {"<": 1, ">": -1}.get(self.peek(), 0)
            self.k += 1
            if depth == 0:
                break
        return said(self.run[start : self.k]).replace("< ?", "<?")

    def type_name(self) -> str:
        out = self.name() + self.angled()
        while self.peek() == "[" and self.peek(1) == "]":
            out += "[]"
            self.k += 2
        if self.peek() == "...":
            out += "..."
            self.k += 1
        return out

    def heads(self) -> Heads:
        out = Heads()
        while self.k < len(self.run):
            if self.peek() == "@" and self.peek(1) != "interface":
                self.k += 1
                name = self.name()
                out.annotations.append({"name": name, "value": said(self.group()) if self.peek() == "(" else ""})
            elif self.peek() in _MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                out.modifiers.append(self.peek())
                self.k += 1
            else:
                break
        return out

    def file(self) -> list[dict[str, Any]]:
        while self.k < len(self.run):
            if self.peek() == "package":
                self.k += 1
                self.package = self.name()
            elif self.peek() == "import":
                self.k += 1 + (self.peek(1) == "static")
                self.imports.append(self.name())
            elif self.peek() == ";":
                self.k += 1
            else:
                start = self.run[self.k]
                heads = self.heads()
                if not self.declared(heads, start, None):
                    self.k += 1
        return self.rows

    def declared(self, heads: Heads, start: Token, parent: str | None) -> bool:
        """Read a type if one is declared here."""
        word = self.peek() + self.peek(1) if self.peek() == "@" else self.peek()
        if word not in _TYPES or not _IN_NAME(self.peek(2 if word == "@interface" else 1)):
            return False
        self.k += 2 if word == "@interface" else 1
        name = self.peek()
        self.k += 1
        self.angled()
        address = f"{parent}${name}" if parent else f"{self.package}.{name}" if self.package else name
        lists: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        if self.peek() == "(":
            self.group()
        while self.peek() in lists:
            here = lists[self.peek()]
            self.k += 1
            here.append(self.type_name())
            while self.peek() == ",":
                self.k += 1
                here.append(self.type_name())
        row = {"package": self.package, "address": address, "parent": parent, "name": name, "kind": _TYPES[word], "modifiers": heads.modifiers, "annotations": heads.annotations, "imports": self.imports, "extends": lists["extends"], "implements": lists["implements"], "description": summary(start.comment), "line_start": start.line, "fields": [], "methods": []}
        self.rows.append(row)
        if self.peek() == "{":
            self.k += 1
            if word == "enum":
                self.constants()
            self.members(row)
        row["line_end"] = self.run[min(self.k, len(self.run)) - 1].line
        lines = self.text.split("\n")[row["line_start"] - 1 : row["line_end"]]
        row["lines_of_code"] = sum(1 for x in lines if x.strip() and not x.strip().startswith(("//", "/*", "*")))
        return True

    def constants(self) -> None:
        while self.k < len(self.run) and self.peek() not in (";", "}"):
            if self.peek() in _OPEN:
                self.group()
            else:
                self.k += 1
        self.k += self.peek() == ";"

    def members(self, row: dict[str, Any]) -> None:
        while self.k < len(self.run):
            if self.peek() == "}":
                self.k += 1
                return
            if self.peek() == ";":
                self.k += 1
                continue
            start = self.run[self.k]
            heads = self.heads()
            if self.peek() == "{":
                self.group()
            elif not self.declared(heads, start, row["address"]):
                before = self.k
                self.member(row, heads, start)
                self.k = max(self.k, before + 1)

    def member(self, row: dict[str, Any], heads: Heads, start: Token) -> None:
        self.angled()
        constructor = self.peek() == row["name"] and self.peek(1) == "("
        kind = "" if constructor else self.type_name()
        name = "<init>" if constructor else self.peek()
        self.k += 1
        if self.peek() == "(":
            parameters = self.parameters()
            thrown = []
            while self.peek() == "[":
                self.group()
            if self.peek() == "throws":
                self.k += 1
                thrown.append(self.type_name())
                while self.peek() == ",":
                    self.k += 1
                    thrown.append(self.type_name())
            body, first, last = [], 0, start.line
            if self.peek() == "{":
                first = self.run[self.k]
                body = self.group()
                last = self.run[self.k - 1]
                text, count = self.text[first.at : last.at + 1], last.line - first.line + 1
                last = last.line
            else:
                while self.k < len(self.run) and self.peek() not in (";", "}"):
                    self.k += 1
                last = self.run[min(self.k, len(self.run) - 1)].line
                text, count = None, 0
                self.k += self.peek() == ";"
            row["methods"].append({"name": name, "modifiers": heads.modifiers, "annotations": heads.annotations, "return_type": kind, "parameters": parameters, "throws": thrown, "line_start": start.line, "line_end": last, "line_count": count, "body": text, "description": summary(start.comment), "_body": body})
            return
        while self.k < len(self.run):
            row["fields"].append({"name": name, "type": kind, "modifiers": heads.modifiers, "annotations": [a["name"] for a in heads.annotations], "line": start.line})
            while self.k < len(self.run) and self.peek() not in (",", ";", "}"):
                if self.peek() in _OPEN:
                    self.group()
                elif self.peek() == "<":
                    self.angled()
                else:
                    self.k += 1
            if self.peek() != ",":
                self.k += self.peek() == ";"
                return
            name = self.peek(1)
            self.k += 2

    def parameters(self) -> list[dict[str, Any]]:
        inner = Reader("")
        inner.run = self.group()
        out = []
        while inner.k < len(inner.run):
            heads = inner.heads()
            kind = inner.type_name()
            out.append({"name": inner.peek(), "type": kind, "annotations": [a["name"] for a in heads.annotations]})
            while inner.k < len(inner.run) and inner.peek() != ",":
                inner.k += 1
            inner.k += 1
        return out


def _scope(run: list[Token], k: int) -> int | None:
    """Where the expression begins on which the call of run[k] is made; None where there is none."""
    if k == 0 or run[k - 1].text != ".":
        return None
    j = k - 1
    while j > 0 and run[j].text == ".":
        j -= 1
        while run[j].text in ")]":
            depth = 0
            while j >= 0:
                depth += (run[j].text in ")]") - (run[j].text in "([")
                if depth == 0:
                    break
                j -= 1
            if j <= 0 or not _BEFORE_CALL(run[j - 1].text) or run[j - 1].text in _NO_CALL:
                return max(j, 0)
            j -= 1
        if j == 0 or run[j - 1].text != ".":
            break
        j -= 1
    return j


def _arguments(run: list[Token], k: int) -> list[str]:
    """The arguments of the group that opens at run[k]."""
    out, depth, since = [], 0, k + 1
    for j in range(k, len(run)):
        depth += (run[j].text in _OPEN) - (run[j].text in _CLOSE)
        if depth == 0 or depth == 1 and run[j].text == ",":
            if j > since:
                out.append(said(run[since:j]))
            since = j + 1
        if depth == 0:
            break
    return out


def _until(run: list[Token], k: int, end: str) -> list[Token]:
    depth = 0
    for j in range(k, len(run)):
        if depth == 0 and run[j].text == end:
            return run[k:j]
        depth += (run[j].text in _OPEN) - (run[j].text in _CLOSE)
        if depth < 0:
            return run[k:j]
    return run[k:]


def _inside(run: list[Token], k: int) -> list[Token]:
    """The tokens inside the brackets that open at run[k]."""
    return _until(run, k + 1, ")") if k < len(run) and run[k].text == "(" else []


def analysed(body: list[Token], known: dict[str, str]) -> dict[str, Any]:
    """known: types of names. Calls, key statements, complexity and structure of a body."""
    known, statements, calls, structure, complexity = dict(known), [], [], [], 1
    for k, t in enumerate(body):
        word, after = t.text, body[k + 1].text if k + 1 < len(body) else ""
        if word in ("if", "while", "catch"):
            complexity += 1
        if word == "do":
            complexity -= 1  # its while is none of its own
        if word == "for":
            each = any(x.text == ":" for x in _inside(body, k + 1)) and not any(x.text == ";" for x in _inside(body, k + 1))
            complexity += each
            structure.append("FOREACH" if each else "FOR")
        elif word in _STRUCTURE:
            structure.append(_STRUCTURE[word])
        if word == "if":
            statements.append({"type": "CONDITION", "text": said(_inside(body, k + 1)), "line": t.line})
        elif word in ("throw", "return"):
            text = said(_until(body, k + 1, ";"))
            statements.append({"type": word.upper(), "text": text or "void", "line": t.line})
        elif word == "synchronized" and after == "(":
            statements.append({"type": "SYNCHRONIZED", "text": said(_inside(body, k + 1)), "line": t.line})
        if _NAME(word) and _NAME(after) and word not in _NO_CALL and after not in ("instanceof", "implements", "extends") and k + 2 < len(body) and body[k + 2].text in ("=", ";", ":"):
            known[after] = word
            structure.append(f"VAR({word})")
        elif after == ">" and k + 3 < len(body) and _NAME(body[k + 2].text) and body[k + 3].text in ("=", ";", ":"):
            back = k
            while back > 0 and body[back].text != "<":
                back -= 1
            if back > 0:
                known[body[k + 2].text] = body[back - 1].text
                structure.append(f"VAR({body[back - 1].text})")
        if after == "(" and _NAME(word) and word not in _NO_CALL:
            begin = _scope(body, k)
            if (begin if begin is not None else k) > 0 and body[(begin if begin is not None else k) - 1].text == "new" and (begin is None or not any(x.text == ")" for x in body[begin:k])):
                continue
            scope = "" if begin is None else said(body[begin : k - 1])
            calls.append({"scope": scope, "name": word, "on": known.get(scope.removeprefix("this."), scope if _TYPE_NAME(scope) else None), "arguments": _arguments(body, k + 1), "line": t.line})
            structure.append(f"CALL({word})")
            if scope not in ("", "this", "super"):
                statements.append({"type": "EXTERNAL_CALL", "text": f"{scope}.{word}", "line": t.line})
    order = {"CONDITION": 0, "THROW": 1, "RETURN": 2, "EXTERNAL_CALL": 3, "SYNCHRONIZED": 4}
    return {"calls": calls, "statements": sorted(statements, key=lambda s: order[s["type"]]), "complexity": complexity, "structure": ";".join(structure)}


def resolved(name: str | None, package: str, imports: list[str]) -> str | None:
    """The full name of a type: as it is if dotted, by import, in java.lang, else in the package."""
    if name is None:
        return None
    bare = re.sub(r"[<\[].*", "", name)
    if "." in bare:
        return bare
    found = next((i for i in imports if i.endswith("." + bare)), None)
    if found:
        return found
    if bare in _LANG:
        return f"java.lang.{bare}"
    return f"{package}.{bare}" if package else bare


_LANG = frozenset("Object String StringBuilder StringBuffer Integer Long Double Float Boolean Short Byte Character Number Math System Thread Runtime Class Exception RuntimeException IllegalStateException IllegalArgumentException Iterable Runnable Enum Record Override".split())


def read_file(text: str | None) -> list[dict[str, Any]]:
    """The classes of a file, in the order of their declarations."""
    reader = Reader(text or "")
    for row in reader.file():
        known = {f["name"]: f["type"] for f in row["fields"]}
        for m in row["methods"]:
            m |= analysed(m.pop("_body"), known | {p["name"]: p["type"] for p in m["parameters"]})
            for c in m["calls"]:
                c["target"] = row["address"] if c["scope"] in ("", "this") else resolved(c.pop("on"), row["package"], row["imports"])
                c.pop("on", None)
    return reader.rows


_ANNOTATION = "struct<name:string,value:string>"
_METHOD = (
    f"struct<name:string,modifiers:array<string>,annotations:array<{_ANNOTATION}>,return_type:string,parameters:array<struct<name:string,type:string,annotations:array<string>>>,throws:array<string>,"
    "line_start:int,line_end:int,line_count:int,body:string,description:string,calls:array<struct<scope:string,name:string,target:string,arguments:array<string>,line:int>>,statements:array<struct<type:string,text:string,line:int>>,complexity:int,structure:string>"
)
CLASSES = (
    f"path string, package string, address string, parent string, name string, kind string, modifiers array<string>, annotations array<{_ANNOTATION}>, imports array<string>, extends array<string>, implements array<string>, description string, "
    f"line_start int, line_end int, lines_of_code int, fields array<struct<name:string,type:string,modifiers:array<string>,annotations:array<string>,line:int>>, methods array<{_METHOD}>, error string"
)


#: What a task has read is held as Python objects for so many files.
FILES_A_BATCH = 500


def classes(files: DataFrame) -> DataFrame:
    """files: path, content. A row for each type that is declared, inner ones with their parent's address."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(CLASSES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, FILES_A_BATCH):
                batch, rows = whole.slice(i, FILES_A_BATCH), []
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        rows += [row | {"path": path, "error": None} for row in read_file(content)]
                    except Exception as failed:  # a file that cannot be read is reported, not hidden
                        rows.append({"path": path, "error": f"{type(failed).__name__}: {failed}"})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, CLASSES)


def methods(found: DataFrame) -> DataFrame:
    """A row for each method, with the address and annotations of its class."""
    return found.select("path", "package", F.col("address").alias("class_address"), F.col("name").alias("class_name"), F.col("annotations").alias("class_annotations"), F.explode("methods").alias("m")).select("path", "package", "class_address", "class_name", "class_annotations", "m.*")


def method_address(m: DataFrame) -> Column:
    """class#name(types)."""
    return F.concat("class_address", F.lit("#"), "name", F.lit("("), F.array_join(F.transform("parameters", lambda p: p["type"]), ","), F.lit(")"))


# Packages whose calls are no edges.
LEFT_OUT = ("java.", "javax.", "jdk.", "org.slf4j", "org.apache.log4j")


def call_edges(found: DataFrame) -> DataFrame:
    """source, target, type: what public and protected methods call in other classes of the code, once each."""
    m = methods(found)
    open_ = F.arrays_overlap("modifiers", F.array(F.lit("public"), F.lit("protected")))
    calls = m.filter(open_).select(method_address(m).alias("source"), "class_address", F.explode("calls").alias("c")).filter("c.target is not null and c.target != class_address")
    for prefix in LEFT_OUT:
        calls = calls.filter(~F.col("c.target").startswith(prefix))
    return calls.select("source", F.concat("c.target", F.lit("#"), "c.name").alias("target"), F.lit("CALLS").alias("type")).distinct()


def key_statements(found: DataFrame) -> DataFrame:
    """method, seq, type, text, line: conditions, throws, returns, calls on others and locks of all bodies."""
    m = methods(found)
    return m.select(method_address(m).alias("method"), F.posexplode("statements").alias("seq", "s")).select("method", "seq", "s.*")


def _named(annotations: str, names: tuple[str, ...]) -> Column:
    return F.exists(annotations, lambda a: F.element_at(F.split(a["name"], "[.]"), -1).isin(*names))


def _value(annotations: str, names: tuple[str, ...], pattern: str) -> Column:
    """What the pattern finds in the first annotation of these names."""
    own = F.filter(annotations, lambda a: F.element_at(F.split(a["name"], "[.]"), -1).isin(*names))
    return F.coalesce(F.regexp_extract(F.get(own, F.lit(0))["value"], pattern, 1), F.lit(""))


# Annotations that make a method an entry point, in the order in which they are tried.
MAPPINGS = ("RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping")
LISTENERS = ("JmsListener", "KafkaListener", "RabbitListener", "StreamListener")


def entry_points(found: DataFrame) -> DataFrame:
    """class, method, type, detail (path, schedule or topic), http, line. The first kind that fits counts; a main method is one besides."""
    m = methods(found)
    kinds = (("REST_CONTROLLER", MAPPINGS), ("EVENT_LISTENER", ("EventListener",)), ("SCHEDULED_TASK", ("Scheduled",)), ("POST_CONSTRUCT", ("PostConstruct",)), ("MESSAGE_CONSUMER", LISTENERS))
    kind = F.lit(None).cast("string")
    for name, annotations in kinds:
        kind = F.coalesce(kind, F.when(_named("annotations", annotations), name))
    detail = F.when(F.col("type") == "REST_CONTROLLER", _value("annotations", MAPPINGS, '"([^"]*)"')).when(F.col("type") == "SCHEDULED_TASK", _value("annotations", ("Scheduled",), 'cron = "([^"]*)"')).when(F.col("type") == "MESSAGE_CONSUMER", _value("annotations", LISTENERS, '"([^"]*)"')).otherwise("")
    verb = F.lit("")
    for name in ("Get", "Post", "Put", "Delete", "Patch"):
        verb = F.when(_named("annotations", (f"{name}Mapping",)), name.upper()).otherwise(verb)
    by_annotation = m.withColumn("type", kind).filter("type is not null").select("class_address", F.col("name").alias("method"), "type", detail.alias("detail"), F.when(F.col("type") == "REST_CONTROLLER", verb).otherwise("").alias("http"), F.col("line_start").alias("line"))
    main = m.filter((F.col("name") == "main") & F.array_contains("modifiers", "public") & F.array_contains("modifiers", "static") & (F.size("parameters") == 1) & (F.get("parameters", F.lit(0))["type"] == "String[]"))
    return by_annotation.unionByName(main.select("class_address", F.col("name").alias("method"), F.lit("MAIN_METHOD").alias("type"), F.lit("").alias("detail"), F.lit("").alias("http"), F.col("line_start").alias("line")))


# Kinds of beans by what an annotation's name holds; the last annotation that fits decides.
BEANS = (("Controller", "CONTROLLER"), ("Service", "SERVICE"), ("Repository", "REPOSITORY"), ("Component", "COMPONENT"), ("Configuration", "CONFIGURATION"))
INJECTS = ("Autowired", "Inject", "Resource")


def beans(found: DataFrame) -> DataFrame:
    """address, type of every class that an annotation makes a bean."""

    def kind(name: Column) -> Column:
        out = F.lit(None).cast("string")
        for part, value in BEANS:
            out = F.coalesce(out, F.when(name.contains(part), value))
        return out

    kinds = F.array_compact(F.transform("annotations", lambda a: kind(a["name"])))
    return found.filter("kind = 'CLASS'").select("address", F.get(kinds, F.size(kinds) - 1).alias("type")).filter("type is not null")


def injections(found: DataFrame) -> DataFrame:
    """source, target (the type as written), how (FIELD, CONSTRUCTOR or METHOD), name."""
    inject = lambda names: F.exists(names, lambda x: x.isin(*INJECTS))
    fields = found.select(F.col("address").alias("source"), F.explode("fields").alias("f")).filter(inject("f.annotations")).select("source", F.col("f.type").alias("target"), F.lit("FIELD").alias("how"), "f.name")
    m = methods(found)
    marked = lambda p: F.exists(p["annotations"], lambda x: x.isin(*INJECTS, "Qualifier"))
    made = m.filter("name = '<init>'").select(F.col("class_address").alias("source"), F.explode(F.filter("parameters", marked)).alias("p")).select("source", F.col("p.type").alias("target"), F.lit("CONSTRUCTOR").alias("how"), "p.name")
    given = m.filter("name != '<init>'").filter(_named("annotations", INJECTS) & (F.size("parameters") > 0)).select(F.col("class_address").alias("source"), F.get("parameters", F.lit(0)).alias("p")).select("source", F.col("p.type").alias("target"), F.lit("METHOD").alias("how"), "p.name")
    return fields.unionByName(made).unionByName(given)


def body_hash(structure: Column) -> Column:
    """Eight digits that depend on the kinds of statements, calls and variables of a body and their order, not on names of variables or values."""
    return F.left(F.sha2(structure, 256), F.lit(8))


def signature(found: DataFrame) -> DataFrame:
    """address, signature: a text that does not depend on the order of imports, modifiers, fields and methods; hash, its first eight digits."""
    joined = lambda c, by=",": F.array_join(F.array_sort(c), by)
    fields = F.transform("fields", lambda f: F.concat_ws(" ", f["type"], f["name"]))

    def one(m: Column) -> Column:
        parameters = F.array_join(F.transform(m["parameters"], lambda p: F.concat_ws(" ", p["type"], p["name"])), ",")
        body = F.when(m["body"].isNull(), ":abstract").otherwise(F.concat(F.lit(":body="), body_hash(m["structure"])))
        return F.concat(m["name"], F.lit("("), parameters, F.lit(")->"), m["return_type"], F.lit(":"), joined(m["modifiers"]), body)

    own = F.filter("methods", lambda m: m["name"] != "<init>")
    parts = [
        F.concat(F.lit("package:"), "package"),
        F.concat(F.lit("imports:"), joined("imports")),
        F.concat_ws(":", F.lit("type"), "kind", "name", joined("modifiers"), F.when(F.size("extends") > 0, F.concat(F.lit("extends="), joined("extends"))), F.when(F.size("implements") > 0, F.concat(F.lit("implements="), joined("implements")))),
        F.concat(F.lit("fields:"), joined(fields, ";")),
        F.concat(F.lit("methods:"), joined(F.transform(own, one), ";")),
    ]
    text = found.filter("error is null").select("address", F.concat_ws("\n", *parts).alias("signature"))
    return text.withColumn("hash", F.left(F.sha2("signature", 256), F.lit(8)))
