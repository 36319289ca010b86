"""Calculations written in texts: found by their form, evaluated exactly, and compared with what the text claims."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_DOWN, Decimal, DivisionByZero, InvalidOperation, Overflow

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\d+(?:\.\d+)?|[-+*/()]")
RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3}
SIGNS = str.maketrans({",": ".", "−": "-", "–": "-", "—": "-", "×": "*", "·": "*", "÷": "/"})
# Digits, signs and brackets, at least two operands, then the claimed result; nothing is given back once it is matched.
_OPERAND = r"(?:\(\s*)*+\d++(?:[.,]\d++)?+(?:\s*\))*+"
EQUATION = rf"(?<![\d.,]){_OPERAND}(?:\s*[-+*/×·÷−–—]\s*{_OPERAND})++\s*=\s*-?\d++(?:[.,]\d++)?+"
DIFFERENCE = r"(\d+(?:[.,]\d+)?)\s?([A-Za-z/²]+)\s?\((\d+(?:[.,]\d+)?)\s?(?:[A-Za-z/²]+\s?)?[−–—-]\s?(\d+(?:[.,]\d+)?)\s?[A-Za-z/²]+\)"


def _apply(op: str, values: list[Decimal]) -> None:
    if op == "neg":
        values.append(-values.pop())
        return
    b, a = values.pop(), values.pop()
    values.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b)


def evaluate(expression: str | None) -> Decimal | None:
    """Value of a plain expression of numbers, signs and brackets, to 28 digits; null for anything else, also for a
    division by zero. Commas are decimal signs. One pass with two stacks, so no code is ever run."""
    if not expression:
        return None
    text = expression.translate(SIGNS)
    tokens = TOKEN.findall(text)
    # Nothing but tokens and white space may be there.
    if not tokens or sum(map(len, tokens)) != len("".join(text.split())):
        return None
    values: list[Decimal] = []
    ops: list[str] = []
    operand = True
    try:
        for t in tokens:
            if t[0].isdigit():
                if not operand:
                    return None
                values.append(Decimal(t))
                operand = False
            elif t == "(":
                if not operand:
                    return None
                ops.append(t)
            elif t == ")":
                if operand:
                    return None
                while ops and ops[-1] != "(":
                    _apply(ops.pop(), values)
                if not ops:
                    return None
                ops.pop()
            elif operand:
                if t not in "+-":
                    return None
                if t == "-":
                    ops.append("neg")
            else:
                while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[t]:
                    _apply(ops.pop(), values)
                ops.append(t)
                operand = True
        if operand or "(" in ops:
            return None
        while ops:
            _apply(ops.pop(), values)
        return values[0]
    except (DivisionByZero, InvalidOperation, Overflow):
        return None


NUMBER = re.compile(r"\s*-?\d+(?:[.,]\d+)?\s*")


def number(text: str | None) -> Decimal | None:
    return Decimal(text.replace(",", ".").strip()) if text and NUMBER.fullmatch(text) else None


def cut_decimals(value: Decimal, places: int) -> Decimal:
    return value.quantize(Decimal(1).scaleb(-places), rounding=ROUND_DOWN)


def equations(texts: DataFrame) -> DataFrame:
    """``(id, n, expression, claimed)``: every "expression = number" and every "result unit (a – b unit)" of a text, in
    order of the two forms."""

    none = F.array().cast("array<struct<expression:string,claimed:string>>")
    whole = F.transform(
        F.regexp_extract_all("text", F.lit(EQUATION), F.lit(0)),
        lambda m: F.struct(F.trim(F.substring_index(m, "=", 1)).alias("expression"), F.trim(F.substring_index(m, "=", -1)).alias("claimed")),
    )
    groups = [F.regexp_extract_all("text", F.lit(DIFFERENCE), F.lit(g)).alias(f"g{g}") for g in (1, 3, 4)]
    pairs = F.transform(F.arrays_zip(*groups), lambda x: F.struct(F.concat(x["g3"], F.lit(" - "), x["g4"]).alias("expression"), x["g1"].alias("claimed")))
    # Cheap tests first: most texts hold neither form.
    all_ = F.concat(
        F.when(F.contains("text", F.lit("=")), whole).otherwise(none),
        F.when(F.rlike("text", F.lit(r"\d\s?[A-Za-z/²]+\s?\(\d")), pairs).otherwise(none),
    )
    return texts.select("id", F.posexplode(all_).alias("n", "e")).select("id", "n", "e.*")


def verify(rows: DataFrame, factor: int = 100) -> DataFrame:
    """``rows(…, expression, claimed)`` with ``right`` and ``status``: ``ok``, ``wrong``, ``implausible`` (more than
    ``factor`` times off, so likely misread) or ``invalid``.

    The value is cut, not rounded, to the decimals of the claim and may differ by half a unit of its last one."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", right string, status string"
    names = [*rows.columns, "right", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right, status = [], []
            for e, c in zip(b.column("expression").to_pylist(), b.column("claimed").to_pylist()):
                value, claim = evaluate(e), number(c)
                if value is None or claim is None:
                    right.append(None)
                    status.append("invalid")
                    continue
                places = min(6, max(0, -claim.as_tuple().exponent))
                got = cut_decimals(value, places)
                right.append(str(got))
                off = claim != 0 and (abs(value) > factor * abs(claim) or factor * abs(value) < abs(claim))
                status.append("implausible" if off else "wrong" if abs(got - claim) > Decimal(5).scaleb(-places - 1) else "ok")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(right, pa.string()), pa.array(status, pa.string())], names=names)

    return rows.mapInArrow(run, schema)


def injectable(rows: DataFrame) -> DataFrame:
    """Right equations ``(id, n, expression, claimed)`` with ``wrong``, a near value for a made-up mistake: one more for a
    whole difference, else eleven hundredths; a tenth, at least one, for products; a tenth, at least a half, for quotients."""
    from prufspark.functions.numbers import like_number, parse_number, truncated

    value = parse_number(F.col("claimed"))
    product, quotient = F.rlike("expression", F.lit("[*×·]")), F.rlike("expression", F.lit("[/÷]"))
    wrong = (
        F.when(quotient, truncated(value + F.greatest(F.lit(0.5), F.abs(value) * 0.1)))
        .when(product, value + F.greatest(F.lit(1.0), value * 0.1))
        .otherwise(value + F.when(value == F.floor(value), 1.0).otherwise(value * 0.11))
    )
    kind = F.when(quotient, "QUOTIENT").when(product, "PRODUKT").otherwise("DIFFERENZ")
    return verify(rows).where("status = 'ok'").select("id", "n", "expression", "claimed", kind.alias("subtype"), like_number(wrong, F.col("claimed")).alias("wrong"))
