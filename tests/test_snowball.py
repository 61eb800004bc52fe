"""The Snowball stemmer on published pairs of words and stems."""

import pytest
from pyspark.sql import functions as F

from hearsay.functions.snowball import snowball_word
from hearsay.operators import tokens as T

# Published sample vocabulary of the algorithm, and its listed exceptions.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skis ski skies sky dying die idly idl gently gentl ugly ugli early earli only onli singly singl sky sky news news bias bias inning inning outing outing proceed proceed
exceed exceed succeed succeed herring herring generate generat general general generically generic communism communism arsenal arsenal
hopping hop hoping hope luxuriated luxuri cry cri by by say say gas gas this this gaps gap kiwis kiwi ties tie cries cri flies fli dies die agreed agre feed feed
plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size falling fall hissing hiss fizzed fizz failing fail filing file
relational relat conditional condit rational ration vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic formative format formalize formal electricity electr electrical electr
hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt activate activ homologous homolog effective effect probate probat rate rate cease ceas controlling control rolling roll
analogy analog apologies apolog beautifully beauti carelessly careless happily happili at at a a y y youth youth enjoying enjoy""".split()


def test_published_pairs(spark):
    pairs = list(zip(PAIRS[::2], PAIRS[1::2]))
    got = {r.w: r.s for r in spark.createDataFrame(pairs, "w string, want string").select("w", snowball_word(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w, _ in pairs} == dict(pairs)


@pytest.mark.parametrize("method", ["light", "snowball"])
def test_stems_by_row_by_word_and_by_count_agree(spark, method):
    df = spark.createDataFrame([(1, ["hopping", "skies", "hopping", None]), (2, []), (3, None), (4, ["generously", "news"])], "id int, w array<string>")
    rows = {r.id: r.stems for r in T.stem(df, "w", method=method).collect()}
    by_word = {r.id: r.stems for r in T.stem_distinct(df, "w", "id", method=method).collect()}
    assert by_word == {i: [x for x in v or [] if x is not None] for i, v in rows.items()}
    counts = {r.stem: r["count"] for r in T.stem_counts(T.word_count(df, "w"), method=method).where("stem IS NOT NULL").collect()}
    flat = [x for v in by_word.values() for x in v]
    assert counts == {x: flat.count(x) for x in flat}
