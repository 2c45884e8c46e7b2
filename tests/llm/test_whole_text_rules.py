"""Cards and dates beside other characters."""

import re

import pytest

from polyview.llm import pseudonyms

KEY = pseudonyms.Pseudonyms(b"k")
CARD = "4111 1111 1111 1111"


@pytest.mark.parametrize(
    "text",
    [f"{CARD} 12/25", "4111111111111111 123", f"12 {CARD}", "12-4111-1111-1111-1111", f"123456 {CARD}", f"{CARD} 1234", f"1234 {CARD} 99", "7 3782 822463 10005 1234", f"1 2 3 {CARD} 4 5"],
)
def test_cards_beside_numbers_are_found(text):
    card = re.search(r"4111[ -]?1111[ -]?1111[ -]?1111|3782 822463 10005", text)
    new, counts = KEY.rewrite(text)
    assert counts["card"] == 1 and sum(counts.values()) == 1
    assert new[: card.start()] == text[: card.start()] and new[card.end() :] == text[card.end() :]
    assert new[card.start() : card.end()] == KEY.rewrite(card[0])[0] != card[0]


@pytest.mark.parametrize("text", ["2024-01-02T10:00:00Z", "at 2024-02-29T23:59, then", "2024-01-02t10:00"])
def test_dates_before_a_time_are_found(text):
    new, counts = KEY.rewrite(text)
    assert counts["date"] == 1 and len(new) == len(text) and new != text
    assert KEY.rewrite(new, back=True)[0] == text
    assert re.sub(r"\d{4}-\d{2}-\d{2}", "", new) == re.sub(r"\d{4}-\d{2}-\d{2}", "", text)


def test_other_kinds_inside_what_is_no_card():
    for text, kind in [("12345 2024-01-02 1235", "date"), ("77 219-09-9999 12345", "ssn"), (f"12 2024-01-02 {CARD}", "date")]:
        new, counts = KEY.rewrite(text)
        assert counts[kind] == 1 and new != text and len(new) == len(text)
        assert counts["card"] == (CARD in text)


@pytest.mark.parametrize("text", ["2023-02-30T10:00", "2024-01-02Tuesday", "4111 1111 1111 1112 123", "1 2 3 4 5 6 7 8 9 10 11 12", "41111111111111111111111"])
def test_what_is_no_value_stays(text):
    assert KEY.rewrite(text) == (text, dict.fromkeys(pseudonyms.KINDS, 0))
