"""Seed prefixes of question searches."""

from __future__ import annotations

# The seeds, each meant to be followed by a space.
SEEDS = (
    "que", "cual", "cuales", "quien", "quienes", "cuanto", "cuanta", "cuantos", "cuantas", "cuando", "donde", "como",
    "porque", "adonde", "debe", "deberia", "deberian", "puede", "pueden", "podria", "por que", "razones por las que",
    "razones para", "razones de", "razones del", "razones de por que", "buenas razones para", "motivos por los que",
    "motivos para", "motivos de", "motivos del", "motivos de por que", "buenos motivos para", "pros y contras de",
    "por que debe", "por que deberia", "por que no", "a que", "a cual", "a cuales", "a quien", "a quienes", "a cuantos",
    "a cuantas", "a donde", "ante que", "ante cual", "ante cuales", "ante quien", "ante quienes", "bajo que", "bajo cual",
    "bajo cuales", "con que", "con cual", "con cuales", "con quien", "con quienes", "con cuanto", "con cuanta",
    "con cuantos", "con cuantas", "de que", "de cual", "de quien", "de quienes", "de cuanto", "de cuanta", "de cuantos",
    "de cuantas", "de donde", "desde que", "desde donde", "durante que", "durante cual", "durante cuales",
    "durante cuanto", "durante cuantos", "en que", "en cual", "en cuales", "en quien", "en cuanto", "en cuantos",
    "en cuantas", "en donde", "entre que", "entre cuales", "entre quienes", "hacia que", "hacia cual", "hacia quien",
    "hasta que", "hasta cual", "hasta cuanto", "hasta cuanta", "hasta cuantos", "hasta cuantas", "hasta cuando",
    "hasta donde", "mediante que", "mediante cual", "mediante cuales", "para que", "para cual", "para quien",
    "para quienes", "para cuantos", "para cuantas", "para donde", "por cuanto", "por cuanta", "por cuantos",
    "por cuantas", "por donde", "segun quien", "segun quienes", "sobre que", "sobre cual", "sobre quien",
    "sobre quienes", "tras cuanto", "tras cuantos", "tras cuantas",
)
