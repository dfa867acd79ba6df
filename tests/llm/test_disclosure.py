"""Disclosing terms with the document as the unit: far from the entity, without it, and in any number of letters."""

from reelwright.llm import pii

from .conftest import frame

FAR = "some words that say nothing, and more of them; " * 6
FILLER = [(100 + i, f"plain text {i} to write only, {FAR}", "a") for i in range(60)]


def texts(spark, rows):
    return {r.doc_id: r.text for r in pii.sanitised(frame(spark, rows + FILLER)).collect()}


def test_terms_far_from_an_entity_or_without_it_are_generalised(spark):
    rows = [(i, f"Bellweather {i} {FAR} write to ann.bell@mail.example.org", "a") for i in range(4)]
    rows += [(10, f"BELLWEATHER was here. {FAR} bellweather again, not Bellweathers", "a"), (None, "no id, Bellweather", "a")]
    out = texts(spark, rows)
    assert all(out[i] == f"<about email> {i} {FAR} write to <email>" for i in range(4))
    assert out[10] == f"<about email> was here. {FAR} <about email> again, not Bellweathers" and out[None] == "no id, <about email>"
    assert out[100] == FILLER[0][1]


def test_both_is_counted_over_whole_documents(spark):
    """Near the entity in three of twelve documents only, but with it in all."""
    rows = [(i, f"Bellweather {FAR if i > 2 else i} {i} ann.bell@mail.example.org", "a") for i in range(12)]
    assert all(out.startswith("<about email> ") for i, out in texts(spark, rows).items() if i is not None and i < 12)


def test_short_terms_and_copies(spark):
    rows = [(i, f"王明 {i} {FAR} q@r.st", "a") for i in range(3)] + [(9, "only 王明", "a")]
    # the same text three times is one text: nothing is concluded from it
    rows += [(20 + i, "Copperfield: d.c@x.org", "a") for i in range(3)] + [(30, "Copperfield", "a")]
    out = texts(spark, rows)
    assert out[9] == "only <about email>" and out[0] == f"<about email> 0 {FAR} <email>"
    assert out[30] == "Copperfield" and out[20] == "Copperfield: <email>"


def test_spans_do_not_overlap_matches(spark):
    rows = [(i, f"ann {i} 漢字ann@x.org ann", "a") for i in range(3)]
    spans = {r.doc_id: r.spans for r in pii.report(frame(spark, rows + FILLER)).collect()}
    assert spans[0] == "term:0:3,term:6:8,email:8:17,term:18:21"
