"""Chunking against an independent statement of its rules in plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quarry.operators.chunking import chunk_documents

LIMIT = 250
END = re.compile(r'(?<![A-Z][a-z]\.)(?<![A-Z][a-z][a-z]\.)(?<=[.!?])\s+(?=[A-Z"(\[])')


def pack(parts, joint, split):
    out, held, n = [], [], 0
    for p in parts:
        w = len(p.split())
        if w > LIMIT or n + w > LIMIT:
            if held:
                out.append(joint.join(held))
            held, n = [], 0
        if w > LIMIT:
            out += split(p)
        else:
            held.append(p)
            n += w
    return out + ([joint.join(held)] if held else [])


def by_words(s):
    w = s.split()
    return [" ".join(w[i : i + LIMIT]) for i in range(0, len(w), LIMIT)]


def by_sentences(p):
    return pack([s.strip() for s in END.split(p) if s.strip()], " ", by_words)


def expected(title, content):
    if len(content.split()) <= LIMIT:
        parts = [(None, content)]
    else:
        found, name, lines = [], None, []
        for line in [*content.split("\n"), None]:
            if line is None or re.match(r"^#{1,3}\s+.+$", line):
                if body := "\n".join(lines).strip():
                    found.append((name, body))
                lines = []
                name = line and re.sub(r"^#+\s+", "", line).strip()
            else:
                lines.append(line)
        parts = []
        for name, body in found or [(None, content)]:
            if len(body.split()) <= LIMIT:
                parts.append((name, body))
            else:
                parts += [(name, b) for b in pack([p.strip() for p in body.split("\n\n") if p.strip()], "\n\n", by_sentences)]
    return ["\n\n".join([f"**{title}**", *([f"### {n}"] if n else []), b]) for n, b in parts]


def texts():
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["alpha", "Beta.", "gamma!", "Mr.", "Bob.", "(x", "d?", "E"]) for _ in range(n))
    fixed = ["", "one", words(250), words(251), "# Only\n## Headings", "# A\n" + words(300), "#### no\n" + words(260), "pre " * 240 + "\n# H\n\n## K\nbody " + "x " * 20, "w " * 600]
    for _ in range(60):
        fixed.append("\n".join(rng.choice(["# T{}", "## U", "text", "", "### V v"]).format(rng.random()) + ("\n\n" if rng.random() < 0.4 else "\n") + words(rng.choice([3, 40, 120, 249, 251, 700])) for _ in range(rng.randint(1, 5))))
    return fixed


def test_chunks_follow_the_rules(spark):
    given = texts()
    df = spark.createDataFrame([(str(i), f"t{i}", t) for i, t in enumerate(given)], "id string, title string, content string")
    got = {}
    for r in chunk_documents(df).collect():
        got.setdefault(int(r["document_id"]), []).append((r["chunk_index"], r["chunk_id"], r["content"]))
    for i, t in enumerate(given):
        rows = sorted(got[i])
        assert [c for _, _, c in rows] == expected(f"t{i}", t)
        assert [x[:2] for x in rows] == [(n, f"{i}_{n}") for n in range(len(rows))]


def test_empty_table_and_null_content(spark):
    df = spark.createDataFrame([("1", "t", None)], "id string, title string, content string")
    assert [r["content"] for r in chunk_documents(df).collect()] == ["**t**\n\n"]
    assert chunk_documents(df.limit(0)).count() == 0


def test_white_space_is_trimmed_at_the_ends_without_a_pattern(spark):
    """Every white space character, and characters beside them; a search over the whole text for its end is what took the time."""
    from quarry.functions import text as X

    near = [0x08, 0x0E, 0x1B, 0x21, 0x84, 0x86, 0x9F, 0xA1, 0x180E, 0x200B, 0x2060, 0xFEFF, *map(ord, X.SPACE_CHARS)]
    rows = [(None,), ("",), (X.SPACE_CHARS,)] + [(f"{chr(c)} a{chr(c)}b {chr(c)}",) for c in near]
    df = spark.createDataFrame(rows, "t string")
    assert df.filter(~X.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", rf"^{X.SPACE}+|{X.SPACE}+\z", ""))).count() == 0
    assert "regexp" not in df.select(X.strip(F.col("t")))._jdf.queryExecution().executedPlan().toString()
