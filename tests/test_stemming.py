from pyspark.sql import functions as F

from litscreen.functions.stemming import english_stem

# Pairs from the published sample vocabulary and from the worked examples of the rules.
SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead
kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit
knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
hopping hop hoping hope generate generat generously generous communism communism arsenal arsenal
skies sky dying die news news inning inning exceed exceed gas gas gaps gap this this kiwis kiwi cries cri ties tie
cry cri by by say say relational relat rational ration luxuriated luxuri agreed agre feed feed hopefulness hope
""".split()


def test_sample_vocabulary(spark):
    pairs = list(zip(SAMPLE[::2], SAMPLE[1::2]))
    df = spark.createDataFrame(pairs, "token string, stem string")
    wrong = df.withColumn("ours", english_stem(F.col("token"))).filter("ours != stem").collect()
    assert wrong == []


def test_other_tokens_are_harmless(spark):
    tokens = ["12", "kv1", "élan", "_", "straße", "ы", "aaaaa", "yyy"]
    rows = spark.createDataFrame([(t,) for t in tokens], "token string").select(english_stem(F.col("token"))).collect()
    assert all(r[0] for r in rows)
