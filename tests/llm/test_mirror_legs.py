import datetime
from decimal import Decimal

from ledgerloom.llm import mirror_legs
from ledgerloom.llm.mirror_legs import match_legs

SCHEMA = "leg_id long, entity string, counterparty string, doc_id string, date date, description string, amount decimal(18,2), nth int, pair string"
DAY = datetime.date(2025, 3, 10)


def leg(i, entity, other, doc, days, text, amount):
    return (i, entity, other, doc, DAY + datetime.timedelta(days), text, Decimal(amount) if amount is not None else None, 1, "clash")


def matched(spark, legs):
    return {(r.leg_id_a, r.leg_id_b) for r in match_legs(spark.createDataFrame(legs, SCHEMA)).collect()}


def test_cascade(spark):
    legs = [
        leg(1, "A", "B", "X-00001", 0, "mgmt fee - Jockysby - Mar", "100.00"), leg(2, "B", "A", "Y-00001", 0, "management fee Jocky. 03/2025", "-100.00"),
        leg(3, "A", "B", "X-00002", 0, "royalty Palow MAR-25", "5000.00"), leg(4, "B", "A", "Y-00002", 5, "licence charge PALOW", "-5000.03"),
        leg(5, "A", "B", "X-00003", 0, "see attached", "7000.00"), leg(6, "B", "A", "Y-00003", 14, None, "-7000.00"),
        leg(7, "A", "B", "X-00004", 0, "royalty Tromon Mar", "900.00"), leg(8, "B", "A", "Y-00004", 1, "royalty Tromon Feb", "-900.00"),  # months differ
        leg(9, "A", "C", "X-00005", 0, "interco", "100.00"),  # no mirror
        leg(10, "A", "B", "X-00006", 0, "freight Zolow", "3450.00"), leg(11, "B", "A", "Y-00006", 0, "haulage ZOLOW", "-3540.00"),  # digits swapped
        leg(12, "A", "B", "X-00007", 0, "audit fee Klow", "77.00"), leg(13, "A", "B", "X-00008", 0, "audit fee Klow", "77.00"), leg(14, "B", "A", "Y-00008", 0, "audit fee Klow re 00008", "-77.00"),  # cited
        leg(15, "A", "B", None, 0, None, None), leg(16, None, "B", None, 0, None, "5.00"), leg(17, "A", "B", None, 0, None, "0.00"), leg(18, "B", "A", "Y-9", 40, "mgmt fee", "-999.00"),
    ]
    assert matched(spark, legs) == {(1, 2), (3, 4), (5, 6), (10, 11), (13, 14)}


def test_equal_legs_are_paired_one_by_one(spark, monkeypatch):
    legs = [leg(i, "A", "B", None, 0, "treasury sweep", "10.00") for i in range(60)] + [leg(100 + i, "B", "A", None, 0, "treasury sweep", "-10.00") for i in range(50)]
    got = matched(spark, legs)
    assert len(got) == 50 and len({x for p in got for x in p}) == 100
    monkeypatch.setattr(mirror_legs, "HOT", 10)
    monkeypatch.setattr(mirror_legs, "SALTS", 2)
    salted = matched(spark, legs)
    assert len({x for p in salted for x in p}) == 2 * len(salted) == 100


def test_hot_sets_are_paired_completely(spark, monkeypatch):
    monkeypatch.setattr(mirror_legs, "HOT", 30)
    monkeypatch.setattr(mirror_legs, "SALTS", 8)
    a = [leg(i, "A", "B", None, 0, "treasury sweep", "10.00") for i in range(60)]
    for n in (50, 20):  # the other side over HOT, too, and not
        got = matched(spark, a + [leg(100 + i, "B", "A", None, 0, "treasury sweep", "-10.00") for i in range(n)])
        assert got == {(i, 100 + i) for i in range(n)}


def test_rules_go_on_until_no_pair_is_left(spark, monkeypatch):
    window = (mirror_legs.Rule("amount_window", "equal", 14, "none"), mirror_legs.Rule("near_amount", "near", 14, "none"))
    legs = [leg(i, "A", "B", None, 0, None, "10.00") for i in range(20)] + [leg(100 + i, "B", "A", None, i - 10, None, "-10.00") for i in range(20)]
    legs += [leg(200, "C", "D", None, 0, None, "1000.00"), leg(201, "C", "D", None, 0, None, "1000.50"), leg(202, "D", "C", None, 0, None, "-1000.20"), leg(203, "D", "C", None, 0, None, "-1003.00")]
    for crowd in (1000, 0):  # in order, and by rounds
        monkeypatch.setattr(mirror_legs, "CROWD", crowd)
        got = {(r.leg_id_a, r.leg_id_b) for r in match_legs(spark.createDataFrame(legs[: 40 if crowd else 3] + legs[20 : 40 if crowd else 23] + legs[40:], SCHEMA).distinct(), window).collect()}
        assert len(got) == (22 if crowd else 5) and len({x for p in got for x in p}) == 2 * len(got) and {(200, 202), (201, 203)} <= got


def test_confidence_and_empty(spark):
    legs = [leg(1, "A", "B", "X-00001", 0, "royalty Palow", "10.00"), leg(2, "B", "A", "Y-00001", 0, "royalty Palow re 00001", "-10.00")]
    (r,) = match_legs(spark.createDataFrame(legs, SCHEMA)).collect()
    assert (r.rule, r.confidence) == ("amount_date_site", 0.6667)
    assert match_legs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_confidence_is_the_share_of_cases_a_rule_gets_right_without_their_citations(spark):
    legs = []
    for k in range(8):  # exact rule: the cited leg is the only one
        legs += [leg(10 * k, f"A{k}", "B", f"X-{10000 + k}", 0, "royalty Palow", "10.00"), leg(10 * k + 1, "B", f"A{k}", f"Y-{20000 + k}", 0, f"royalty Palow ref {10000 + k}", "-10.00")]
    for k in range(8):  # nearest amount: another leg is nearer than the cited one in six of eight cases
        i = 1000 + 10 * k
        legs += [leg(i, f"C{k}", "D", f"X-{30000 + k}", 0, None, "500.00"), leg(i + 1, "D", f"C{k}", f"Y-{40000 + k}", 1, f"ref {30000 + k}", "-503.00")]
        legs += [leg(i + 2, "D", f"C{k}", f"Y-{50000 + k}", 1, "ref 99999", "-501.00")] if k < 6 else []
    got = {(r.leg_id_a, r.leg_id_b): (r.rule, r.confidence) for r in match_legs(spark.createDataFrame(legs, SCHEMA)).collect()}
    assert {(10 * k, 10 * k + 1) for k in range(8)} | {(1000 + 10 * k, 1001 + 10 * k) for k in range(8)} == set(got)  # citations still decide the pairs
    exact, near = got[0, 1], got[1000, 1001]
    assert exact[0] == "amount_date_site" and near[0] == "near_amount" and (exact[1], near[1]) == (0.9, 0.3)


def test_no_rule_is_surer_than_a_stricter_one():
    assert mirror_legs.precision([("a", 8, 0), ("b", 98, 0), ("c", 9, 9), ("d", 0, 0), ("e", 5, 1)]) == [("a", 0.9907), ("b", 0.9907), ("c", 0.5769), ("d", 0.5769), ("e", 0.5769)]
    assert mirror_legs.precision([]) == []
