"""Quotation links of parts, of short passages, inside the own conversation, and across gaps of turns."""

import pytest

from lantern.llm import quotes

ROWS = [
    (1, 0, "First thing to say.\n\nSecond thing to say.\n\nThird thing to say."),
    (1, 1, "Line one is here\nline two is here\nline three is here\nline four is here\nline five is here"),
    (1, 2, "> first thing to say.\n>\n> Second thing to say.\n\nAgreed"),
    (1, 3, "> line two is here\n> line three is here\n\nYes, ok"),
    (1, 4, "No more"),
    (1, 5, "> yes, ok\n\nFine"),
    (2, 0, "Thanks for your help"),
    (3, 0, "Hello again to all"),
    (3, 2, "Thanks for your help"),
    (3, 4, "Other words in between"),
    (3, 9000, "> Thanks for your help\n\nWelcome"),
    (3, 9005, "Good night then"),
    (4, 0, "> yes, ok\n\nNo such thing"),
    (5, 0, "Alpha line of text\nbeta line of text\ngamma line of text"),
    (5, 1, "Alpha line of text"),
    (5, 2, "> alpha line of text\n> beta line of text\n\nBoth"),
    (6, 0, "First the meeting is at noon in the big hall and\nnobody may be late for it"),
    (6, 1, "> first the meeting\n\nWhich one?"),
    (6, 2, "No idea about that"),
    (6, 3, "> the big hall and nobody may\n> be late for it\n\nGood"),
    (7, 0, "> nobody may be late\n\nSure"),
    (8, 0, "> nobody shall ever come\n\nUnknown"),
]


@pytest.fixture(scope="module")
def got(spark):
    frame = spark.createDataFrame([(c, t, "u", x) for c, t, x in ROWS], "conv_id long, turn long, role string, text string")
    return {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(frame).collect()}


def parent(got, *at):
    return got[at]["parent_conv"], got[at]["parent_turn"], got[at]["n_quotes"], got[at]["n_linked"]


def test_parts_and_short_passages_link(got):
    assert parent(got, 1, 2) == (1, 0, 1, 1) and parent(got, 1, 3) == (1, 1, 1, 1)
    assert parent(got, 1, 5) == (1, 3, 1, 1) and parent(got, 4, 0) == (1, 3, 1, 1)
    assert parent(got, 5, 2) == (5, 0, 1, 1)


def test_own_conversation_first_and_gaps(got):
    assert parent(got, 3, 9000) == (3, 2, 1, 1)
    assert parent(got, 3, 2) == (3, 0, 0, 0) and parent(got, 3, 4) == (3, 2, 0, 0) and parent(got, 3, 9005) == (3, 9000, 0, 0)
    assert all(got[3, t]["root_turn"] == 0 for t in (2, 4, 9000, 9005))


def test_parts_of_lines_and_other_line_breaks_link(got):
    assert parent(got, 6, 1) == (6, 0, 1, 1) and parent(got, 6, 3) == (6, 0, 1, 1) and parent(got, 7, 0) == (6, 0, 1, 1)
    assert parent(got, 8, 0) == (None, None, 1, 0)


def test_short_passages_by_parameter(spark):
    frame = spark.createDataFrame([(1, 0, "u", "go now"), (2, 0, "u", "> go now\n\nWhy?")], "conv_id long, turn long, role string, text string")
    linked = [{(r["conv_id"]): r["n_linked"] for r in quotes.link_quotes(frame, **p).collect()} for p in ({}, {"least_chars": 8})]
    assert linked == [{1: 0, 2: 1}, {1: 0, 2: 0}]


@pytest.mark.parametrize(
    "head",
    [
        "On " + "a very long name " * 40 + "Bob wrote:",
        "Am 5. Mai schrieb Bob:",
        "On Mon, 5 Jan 2024 at 10:00, Bob Miller\n<bob@example.org> wrote:",
        "On Monday, the first one,\nBob Miller <bob@example.org>\nwrote:",
        "Bob Miller <bob@example.org>:",
        "2024-05-05 10:12, Bob:",
        "Le 5 mai 2024 à 10:12, Bob a écrit :",
    ],
)
def test_attributions_go(head):
    own, passages = quotes.parse_quotes(f"Yes.\n\n{head}\n\n> text\n\nNo")
    assert own.split() == ["Yes.", "No"] and passages == [(1, "text")]
    nested = head.replace("\n", "\n> ")
    assert quotes.parse_quotes(f"> Yes.\n> {nested}\n>> text")[1] == [(1, "Yes."), (2, "text")]


@pytest.mark.parametrize("head", ["Here is my view on the plan of 2024:", "Goethe wrote the following lines:", "Some words"])
def test_other_lines_before_a_quote_stay(head):
    assert quotes.parse_quotes(f"Yes.\n{head}\n> text")[0] == f"Yes.\n{head}"
