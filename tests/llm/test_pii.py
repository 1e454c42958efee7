import pytest

from evtide.llm import pii as P

CASES = [
    ("Write to jane.doe+news@mail.example.org.", [("email", "jane.doe+news@mail.example.org")]),
    ("Mail <A_B@CORR.EXAMPLE.NET>; thanks", [("email", "A_B@CORR.EXAMPLE.NET")]),
    ("cc nora [at] office [dot] test)", [("email", "nora [at] office [dot] test")]),
    ("x(at)mail.example and a at b dot com", [("email", "x(at)mail.example"), ("email", "a at b dot com")]),
    ("meet at noon @ five", []),
    ("tel. (020) 7946-0269, fax 030 / 23125277", [("phone", "(020) 7946-0269"), ("phone", "030 / 23125277")]),
    ("The dial-in is +1-415-555-0144, conference 759.", [("phone", "+1-415-555-0144")]),
    ("T: 13125550194 x675\nE: y", [("phone", "13125550194 x675")]),
    ("Ring us on 312-555-0158 ext. 504 today", [("phone", "312-555-0158 ext. 504")]),
    ("Case file 36485242 and record 71957741 of 2019-05-04", []),
    ("(SSN 666-57-8066) NI number QQ 53 18 49 B, passport no. X00375406; identity card ID-58.0573.254; tax id 00-5722743", [("id_number", "666-57-8066"), ("id_number", "QQ 53 18 49 B"), ("id_number", "X00375406"), ("id_number", "ID-58.0573.254"), ("id_number", "00-5722743")]),
    ("Jourqix National Insurance has 48914833 staff", []),
    ("living at 81 Lindal Street #10, Rome; 799 N. Millbank St., Apt 69C, Bonn", [("street_address", "81 Lindal Street #10"), ("street_address", "799 N. Millbank St., Apt 69C")]),
    ("Uferstr. 148 / Mühlenweg 12 b\n163 bis, rue de la Carrière, Leeds; Calle Mayor Vieja 55 in Ulm", [("street_address", "Uferstr. 148"), ("street_address", "Mühlenweg 12 b"), ("street_address", "163 bis, rue de la Carrière"), ("street_address", "Calle Mayor Vieja 55")]),
    ("Mr. Peter O'Dessmann met MARIA DE YORMANN and Naomi B. van der Halbeck-Smith.", [("person_name", "Peter O'Dessmann"), ("person_name", "MARIA DE YORMANN"), ("person_name", "Naomi B. van der Halbeck-Smith")]),
    ("van Ettquez, Walter\n42 N. Chapel Avenue", [("person_name", "van Ettquez, Walter"), ("street_address", "42 N. Chapel Avenue")]),
    ("thanks, lukas kedley (x)", [("person_name", "lukas kedley")]),
    ("Frau Xqtzia Blorp sprach", [("person_name", "Xqtzia Blorp")]),
    ("Contact: Siobhán Murphy (siobhan.murphy@mail.example) or Wojciech Nowak, w_nowak@desk.example.org", [("person_name", "Siobhán Murphy"), ("email", "siobhan.murphy@mail.example"), ("person_name", "Wojciech Nowak"), ("email", "w_nowak@desk.example.org")]),
    ("Investor Relations, investor.relations@desk.example.org; Acme Widgets <sales@acme.example>", [("email", "investor.relations@desk.example.org"), ("email", "sales@acme.example")]),
    ("- Schmidt, Jürgen at Karl Marx Square", []),
    ("(Schmidt, Jürgen) says my social is 123-45-6789", [("person_name", "Schmidt, Jürgen"), ("id_number", "123-45-6789")]),
    ("Simon Foods and Victor Street in May", []),
    ("", []),
]


@pytest.mark.parametrize("text, spans", CASES)
def test_spans(text, spans):
    assert [(k, text[a:b]) for a, b, k in P.finder().find(text)] == spans


def test_look_alike_letters_keep_their_places():
    text = "M𝔞rtin Kedwick wrote"
    assert [(k, text[a:b]) for a, b, k in P.finder().find(text)] == [("person_name", "M𝔞rtin Kedwick")]


def test_rest_is_unchanged(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(98, None, "x"), (0, CASES[0][0], "x"), (99, "quiet " * 100_000 + "tel. 415-555-0125", "x")]
    docs = spark.createDataFrame(rows, "doc bigint, body string, id string")
    back = {}
    for r in P.redact_pii(docs, "doc", "body").collect():
        back[r.id] = r.text
    assert back[98] is None and back[99] == "quiet " * 100_000 + "tel. [PHONE]" and back[9] == CASES[9][0]
    assert P.redact_pii(docs, "doc", "body").count() == len(rows)
    found = {(r.id, r.pii_type, r.pii_text) for r in P.find_pii(docs, "doc", "body").collect()}
    assert found == {(i, k, s) for i, (_, spans) in enumerate(CASES) for k, s in spans} | {(99, "phone", "415-555-0125")}
    assert P.find_pii(docs.where("false"), "doc", "body").count() == 0


def test_many_spans_take_linear_time():
    import time

    text = "mail jane.doe@mail.example now " * 30_000
    began = time.time()
    assert len(P.finder().find(text)) == 30_000 and time.time() - began < 30
