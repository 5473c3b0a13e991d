"""Licence templates with several edits around phrases that they repeat."""

from motley.llm import license_scan as ls


def test_edits_around_repeated_phrase():
    number = max((i for i, (label, _) in enumerate(ls.TEMPLATES) if label == "mit"), key=lambda i: len(ls.TEMPLATES[i][1]))
    words = ls.words_of(ls.TEMPLATES[number][1])
    places = [i for i in range(len(words) - 2) if words[i:i + 3] == ["of", "the", "software"]]
    assert len(places) > 1
    at = places[0]
    for more in range(at + 14, min(at + 40, len(words) - 1)):
        text = [f"edit{i}" if i in (at - 1, at + 3, more) else w for i, w in enumerate(words)]
        spans = ls.Scanner([], ls.TEMPLATES).scan(" ".join(text))["spans"]
        assert any(s["label"] == "mit" and s["covered"] > 0.9 for s in spans), more
