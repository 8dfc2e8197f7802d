"""Column functions on texts of memories and transcripts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


#: A character of a term, and one between terms.
TERM, BETWEEN = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def folded(text: Column) -> Column:
    """In lower case, without Latin accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits, without Latin accents."""
    return F.regexp_extract_all(folded(text), F.lit(f"{TERM}+"), F.lit(0))


#: How names are written, in order. Word borders are those of ASCII.
NAMES = (
    ("sqlite-vec", "sqlite-vec"), ("sqlite(?!-vec)", "SQLite"), ("postgres(?:ql)?", "PostgreSQL"), ("mysql", "MySQL"), ("javascript", "JavaScript"), ("typescript", "TypeScript"),
    (r"nodejs|node\.js", "Node.js"), ("bun", "Bun"), ("fastify", "Fastify"), ("zod", "Zod"), ("vitest", "Vitest"), ("github", "GitHub"), ("windows", "Windows"), ("macos", "macOS"), ("linux", "Linux"),
)
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


#: The same white space as characters, and what is more than one plain space.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
UNEVEN = f"(?=[^!-~])(?: {SPACE}+|(?! ){SPACE}{SPACE}*)"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(trimmed(text), UNEVEN, " ")


#: The same as one pattern that is looked for once, by the letters with which a name begins; "mac os x" has a border behind it only. Names do not overlap and no name makes another one.
ANY_NAME = f"(?i)(?=[{''.join(sorted({p[0] for p, _ in NAMES}))}])(?:(?<![A-Za-z0-9_])(?:{'|'.join(p for p, _ in NAMES)})|mac os x)(?![A-Za-z0-9_])"
#: What the names look like in lower case, and what a text with any of them holds.
SPELT = {"sqlite-vec": "sqlite-vec", "sqlite": "SQLite", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "nodejs": "Node.js", "node.js": "Node.js", "mac os x": "macOS"} | {n.lower(): n for _, n in NAMES}
HELD = [n for n in SPELT if n not in ("sqlite-vec", "postgresql")]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), which is worked out once; F.get() would do so twice."""
    return F.transform(F.array(value), use)[0]


def _named(text: Column) -> Column:
    """Every name as it is written, in one pass."""
    spelt = F.create_map(*[F.lit(x) for pair in SPELT.items() for x in pair])
    parts = F.arrays_zip(F.split(text, ANY_NAME, -1).alias("gap"), F.regexp_extract_all(text, F.lit(ANY_NAME), F.lit(0)).alias("name"))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], F.coalesce(F.try_element_at(spelt, F.lower(x["name"])), F.lit("")))), "")


def normalized(text: Column) -> Column:
    has = lambda low: reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in HELD])
    return _let(collapsed(text), lambda out: F.when(_let(F.lower(out), has), _named(out)).otherwise(out))


def reduce_key(text: Column) -> Column:
    return F.sha2(F.lower(collapsed(text)), 256)


def cleaned(text: Column) -> Column:
    """Line ends, trailing white space, runs of three or more equal lines, runs of empty lines, and the ends put right."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, f"{SPACE}+$", ""))
    step = lambda s, x: F.when(
        (x == s["last"]) & (x != ""), F.struct(s["out"].alias("out"), x.alias("last"), (s["run"] + 1).alias("run"))
    ).otherwise(F.struct(F.concat(s["out"], _flushed(s)).alias("out"), x.alias("last"), F.lit(1).alias("run")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"))
    kept = F.aggregate(lines, start, step, lambda s: F.concat(s["out"], _flushed(s)))
    return trimmed(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def _flushed(s: Column) -> Column:
    return F.when(s["run"] == 0, F.array().cast("array<string>")).when(s["run"] >= 3, F.array(s["last"])).otherwise(F.array_repeat(s["last"], s["run"]))


def flattened_turns(content: Column) -> Column:
    """role: text lines of a JSON array of turns; whatever else stays as it is."""
    parsed = F.from_json(content, "array<struct<role:string,text:string>>")
    lines = F.transform(parsed, lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    good = parsed.isNotNull() & (F.size(parsed) > 0) & F.forall(parsed, lambda t: t["role"].isNotNull() & t["text"].isNotNull())
    return F.when(good, F.array_join(lines, "\n")).otherwise(content)


#: Prompts that ask for memory, and small talk.
ASKS = r"(?i)(?<![A-Za-z0-9_])(remember|recall|last time|previously|we decided|as before|earlier session|what did (i|we))(?![A-Za-z0-9_])"
SMALLTALK = r"(?i)^\s*(hi|hey|hello|thanks?|thank you|ok(ay)?|yes|no|cool|nice|lol|good (morning|evening|night)|how are you)\s*[!.?]*\s*$"


def entropy(token: Column) -> Column:
    """Shannon entropy of a token's characters, in bits."""
    characters = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.size(characters)
    counts = F.transform(F.array_distinct(characters), lambda c: F.size(F.filter(characters, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def _sorted_fields(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_fields(x, kind.elementType))
    return value


def stable_json(value: Column, kind: T.DataType) -> Column:
    """JSON of a nested value with the keys in order at every level; nulls stay as such."""
    return F.to_json(_sorted_fields(value, kind), {"ignoreNullFields": "false"})


def parsed_query(raw: Column, now_ms: int) -> Column:
    """struct(q, type, repo, project, since_ms) of a query with type:, repo:, project: and since: filters. The last repo, project and
    since of good form (7d, 24h) count; other words, those with unknown prefixes too, stay in q."""
    tokens = F.filter(F.split(F.trim(raw), r"\s+"), lambda x: x != "")
    good = r"^(type|repo|project|since):.+"
    of = lambda key, form=".+": F.transform(F.filter(tokens, lambda x: x.rlike(f"^{key}:{form}$")), lambda x: F.substring(x, len(key) + 2, 2**30))
    last = lambda values: F.try_element_at(values, F.lit(-1))
    span = last(of("since", "[0-9]+[dh]"))
    ms = F.regexp_extract(span, "^[0-9]+", 0).cast("long") * F.when(span.endswith("d"), 86_400_000).otherwise(3_600_000)
    return F.struct(F.array_join(F.filter(tokens, lambda x: ~x.rlike(good)), " ").alias("q"), of("type").alias("type"), last(of("repo")).alias("repo"), last(of("project")).alias("project"), (F.lit(now_ms) - ms).alias("since_ms"))


#: How agents are named, in order.
AGENTS = (("claude-code", "claude-code"), ("claude code", "claude-code"), ("claudecode", "claude-code"), ("cursor", "cursor"), ("copilot", "github-copilot"), ("github copilot", "github-copilot"), ("github-copilot", "github-copilot"))
INSTANT = r"(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:\s*UTC|\s*Z)?"


def normalised_paths(text: Column, home: str) -> Column:
    """Windows paths with forward slashes, and paths below home from ~ on."""
    slashed = F.array_join(
        F.transform(
            F.arrays_zip(F.split(text, WINDOWS_PATH, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WINDOWS_PATH), F.lit(0)).alias("path")),
            lambda x: F.concat(x["gap"], F.coalesce(F.replace(x["path"], F.lit("\\"), F.lit("/")), F.lit(""))),
        ),
        "",
    )
    literal = "".join(f"\\{c}" if not c.isalnum() else c for c in home.replace("\\", "/"))
    start = r"(?<![A-Za-z0-9_/])" if not home[:1].isalpha() else r"(?<![A-Za-z0-9_])"
    return F.regexp_replace(slashed, f"{start}{literal}", "~")


WINDOWS_PATH = r"[A-Za-z]:\\[^\s\"'<>|?*\r\n]+"


def normalised_times(text: Column) -> Column:
    """Dates and times with white space between them, as ISO 8601 in UTC."""
    return F.regexp_replace(text, INSTANT, "$1T$2Z")


def normalised_agents(text: Column) -> Column:
    for alias, name in AGENTS:
        text = F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9_]){alias}(?![A-Za-z0-9_])", name)
    return text


def normalised(text: Column, home: str) -> Column:
    """Paths, times and names of agents, in this order."""
    return normalised_agents(normalised_times(normalised_paths(text, home)))


@F.pandas_udf(T.LongType())
def _seeds(texts: pd.Series) -> pd.Series:
    """The sum of the units times powers of 31, in 32 bits that wrap."""
    units = [None if t is None else np.frombuffer(t.encode("utf-16-le"), "<u2") for t in texts]
    powers = np.cumprod(np.concatenate([[1], np.full(max([len(u) for u in units if u is not None], default=0), 31)]).astype(np.uint32), dtype=np.uint32)
    seed = lambda u: int((u.astype(np.uint32) * powers[: len(u)][::-1]).sum(dtype=np.uint32).astype(np.int32))
    return pd.Series([None if u is None else seed(u) for u in units], dtype="Int64")


def fake_seed(text: Column) -> Column:
    """A signed 32-bit hash of the text's UTF-16 units."""
    return _seeds(text)


def fake_vector(text: Column, size: int = 1024) -> Column:
    """A deterministic vector for tests: sines that start at the text's hash."""
    sines = lambda seed: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.sin(seed * 0.001 + i * 0.01).cast("float"))
    return _let(fake_seed(text), sines)
