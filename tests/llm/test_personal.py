import pytest

from docloom.llm import personal as P

FORMS = [
    ("write to mia.orlen@mail.example.org now", "email", "mia.orlen@mail.example.org"), ("mia.orlen (at) mail [dot] example [dot] org", "email", None), ("mia at mail dot example dot org", "email", None),
    ("x &#64; y", None, None), ("<mailto:mia+k8s@uni.example>", "email", "mia+k8s@uni.example"), ("mia&#64;uni.example", "email", "mia&#64;uni.example"), ("git@forge.example:o/r.git", None, None),
    ("root@worker-3:~#", None, None), ("runner-x@a.serviceaccount.invalid", None, None), ("lib@1.2.3", None, None), ("no-reply@a.example", None, None), ("https://user@host.example/x", None, None),
    ("call +44 7700 900206", "phone", "+44 7700 900206"), ("690.555.0155", "phone", None), ("1-571-555-0119 ext. 667", "phone", "1-571-555-0119 ext. 667"), ("+49 (0)30 23125 646", "phone", None), ("07700900667", "phone", None),
    ("0491 570 453", "phone", None), ("01 99 00 20 14", "phone", None), ("started at 1717422616", None, None), ("10.42.3.461:8080", None, None), ("build 10291-22-1984", None, None), ("+154 -821 =~ 6667", None, None),
    ("SSN 978-19-5945", "id_number", "978-19-5945"), ("social security number: 978 25 3283", "id_number", "978 25 3283"), ("NI number QQ 25 63 15 B", "id_number", "QQ 25 63 15 B"), ("passport X12705031", "id_number", "X12705031"),
    ("Reisepass-Nr. Z39836798", "id_number", "Z39836798"), ("DNI 92364855Y", "id_number", "92364855Y"), ("job X12705031 failed", None, None),
    ("at 12 Elm Park Road, Newtown 12345", "address", "12 Elm Park Road, Newtown 12345"), ("Birkenweg 12, 12345 Kerndorf", "address", "Birkenweg 12, 12345 Kerndorf"), ("80 bis rue du Vieux Quai, 92946 Ort", "address", None),
    ("Calle Almena 1, 9º B, Villa Alta", "address", None), ("P.O. Box 842, Villa Alta", "address", "P.O. Box 842, Villa Alta"), ("Route 14 of the Gateway", None, None), ("Street View Dataset 209", None, None),
]


@pytest.mark.parametrize("text, kind, value", FORMS)
def test_forms(text, kind, value):
    found = P.by_form(text)
    assert [k for _, _, k in found] == ([kind] if kind else [])
    if value:
        a, b, _ = found[0]
        assert text[a:b] == value


def corpus():
    people = [(f, s) for f in ("Mia", "Ravi", "Olga", "Sven") for s in ("Orlen", "Tarvik", "Belmont")]
    rows = []
    for n, (f, s) in enumerate(people):
        rows.append((n, f"I am {f} {s} and I run the cluster.\nThe Blue Harbor release works.", [("x", "d", f"Thanks to {s}, {f} for the trace."), ("y", "d", None)]))
    rows.append((100, "The notebook of Mia Tarvik is affected. Blue Harbor and Model Registry are fine.", None))
    rows.append((101, None, []))
    rows.append((102, " ", None))
    rows.append((103, "Reported by: Dr. Orlen\ncc J. Zelmark from our team", None))
    rows.append((104, "best, olga belmont\nmail ravi.tarvik@a.example", None))
    rows.append((104, "Another row with the same number, +44 7700 900206", None))
    rows.append((105, "Blue Harbor, Model Registry, Green Field", None))
    rows += [(200 + n, "Blue Harbor and Model Registry and Training Operator", None) for n in range(20)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, body string, comments array<struct<author:string,created_at:string,body:string>>")
    return df.selectExpr("id", "body AS body", "comments", "'x' AS text", "'y' AS terms", "'z' AS key", "0 AS segment_no")


def test_names_by_disclosure(spark):
    df = frame(spark, corpus())
    found = {tuple(r) for r in P.kinds_found(df, "id", "body", "comments").collect()}
    people = {(n, s, "name") for n in range(12) for s in (0, 1)}
    assert found == people | {(100, 0, "name"), (103, 0, "name"), (104, 0, "name"), (104, 0, "email"), (104, 0, "phone")}
    assert P.kinds_found(df.limit(0), "id", "body", "comments").count() == 0


def test_sanitized(spark):
    df = frame(spark, corpus())
    out = P.sanitized(df, "id", "body", "comments").collect()
    rows = {(r["id"], (r["body"] or "")[:7]): r for r in out}
    first = next(r for r in out if r["id"] == 0)
    assert first["body"] == "I am <NAME> and I run the cluster.\nThe Blue Harbor release works."
    assert first["comments"][0]["body"] == "Thanks to <NAME> for the trace." and first["comments"][1]["body"] is None and first["comments"][0]["author"] == "x"
    assert next(r for r in out if r["id"] == 101)["body"] is None and next(r for r in out if r["id"] == 102)["body"] == " "
    assert rows[(104, "Another")]["body"].endswith("<PHONE>") and rows[(104, "best, <")]["body"] == "best, <NAME>\nmail <EMAIL>"
    assert len(out) == len(corpus())


def test_long_addresses():
    for local, host in (("a" * 121, "mail.example"), ("a.b" * 60, "x." * 70 + "example")):
        (a, b, kind), = P.by_form(f"write to {local}@{host} now")
        assert (b - a, kind) == (len(local) + 1 + len(host), "email")


def test_cues_are_learned(spark):
    rows = [(n, f"call me on +44 7700 9002{n}", None) for n in range(10, 30)] + [(30 + n, f"insurance number 97{n % 9}-19-59{n} of me", None) for n in range(10, 30)]
    rows += [(80, "please call me on 415 555 0123 today", None), (81, "there are 415 555 0123 rows", None), (82, "the number X12705031 is mine", None), (83, "job X12705031 failed", None)]
    found = {tuple(r) for r in P.kinds_found(frame(spark, rows), "id", "body", "comments").collect()}
    assert found == {(n, 0, "phone") for n in range(10, 30)} | {(30 + n, 0, "id_number") for n in range(10, 30)} | {(80, 0, "phone"), (82, 0, "id_number")}


def test_common_shapes_need_a_word(spark):
    # A cue stands before a few of very many numbers of one shape: the shape does not disclose, the words do.
    rows = [(n, f"ts {10_000_000 + n} done", None) for n in range(300)] + [(400 + n, f"my passport 2000000{n}", None) for n in range(5)] + [(500, "passport\n\nts 10000999", None)]
    found = {tuple(r) for r in P.kinds_found(frame(spark, rows), "id", "body", "comments").collect()}
    assert found == {(400 + n, 0, "id_number") for n in range(5)}
    terms = {r["term"]: r for r in P.disclosing_contexts(P.scan(P.segments_of(frame(spark, rows), "id", "body", "comments"), "id", "segment_no", "text")).collect()}
    assert {t for t, r in terms.items() if r["discloses"]} == {"my", "passport"} and all(r["strong"] and r["bits"] > 5 for r in terms.values() if r["discloses"])
    assert {t for t, r in terms.items() if r["innocent"]} == {"ts"}


def test_innocent_words_tell_against_look_alikes(spark):
    rows = [(n, f"insurance number 97{n % 9}-19-59{n} of me", None) for n in range(10, 40)] + [(100 + n, f"took 10 ms rev {20_000_000 + n}", None) for n in range(40)]
    rows += [(200, "the number X12705031 is mine", None), (201, "number rev X12705031", None)]
    found = {r["id"] for r in P.kinds_found(frame(spark, rows), "id", "body", "comments").collect()}
    assert found == {*range(10, 40), 200}


def test_capitals_of_all_scripts(spark):
    people = [(f, s) for f in ("Иван", "Ольга", "Νίκος") for s in ("Петров", "Ковалёв", "Παππάς")]
    rows = [(n, f"I am {f} {s} and I run the cluster. The Blue Harbor release works.", None) for n, (f, s) in enumerate(people)] + [(50, "The notebook of Иван Παππάς", None), (51, "Синий Порт", None)]
    assert {r["id"] for r in P.kinds_found(frame(spark, rows), "id", "body", "comments").collect()} == {*range(9), 50}
