"""Porter stems against the examples published with the algorithm."""

from postlens.functions.porter import with_stems
from postlens.operators.text import text_features_normalised

# FIXED VALUES: word:stem, whole-algorithm results for the examples of the publication's steps
EXAMPLES = """
caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing
conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file
happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit
conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic
operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit
sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good
revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ
angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll
generalizations:gener oscillators:oscil is:is as:as y:y say:sai yes:ye toy:toi syzygy:syzygi enjoy:enjoi played:plai
"""


def test_published_examples(spark):
    pairs = [p.split(":") for p in EXAMPLES.split()]
    df = spark.createDataFrame([(w,) for w, _ in pairs] + [(None,), ("",)], "word string")
    got = {r.word: r.stem for r in with_stems(df).collect()}
    assert got.pop(None) is None and got.pop("") == ""
    assert {w: s for w, s in pairs if got[w] != s} == {} and len(got) == len(pairs)


def test_features_by_way_of_the_vocabulary(spark):
    posts = spark.createDataFrame([("a", "Dancing dancers danced; stopped running #x"), ("b", None), ("c", "  "), ("d", "@z sky skies sky")],
                                  "post_id string, post_text string")
    got = {r.post_id: r for r in text_features_normalised(posts).collect()}
    assert got["a"].vector_stemmed == ["danc", "dancer", "danc", "stop", "run"]
    assert got["a"].vector_lemma == ["dance", "dancer", "run", "stop", "x"] and got["a"].nbr_words == 5
    assert (got["b"].vector_stemmed, got["b"].vector_lemma, got["b"].nbr_words) == ([], [], 0) and got["c"].nbr_words == 0
    assert got["d"].vector_stemmed == ["sky", "ski", "sky"] and (got["d"].has_mention, got["d"].has_hashtag) == (1, 0)


def test_no_python_and_one_regroup(spark):
    posts = spark.createDataFrame([("a", "words and words")], "post_id string, post_text string")
    plan = text_features_normalised(posts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_forms_by_block_over_odd_rows(spark, monkeypatch):
    """no token moves by itself; blocks, slots with several words or none, ids that repeat, no id."""
    import random
    from collections import defaultdict

    from postlens.functions.lexicons import BAD_TOKENS
    from postlens.operators import blocks as B
    from postlens.operators import text as TX
    monkeypatch.setattr(B, "BATCH_ROWS", 2)
    monkeypatch.setattr(B.looked_up, "__defaults__", (40,))
    rnd = random.Random(5)
    some = "running runs ran skies sky hopping hoped agreed x s happily nationally relational um caresses flies die".split()
    rows = [(None if i % 20 == 7 else f"p{i if i % 3 else i // 9}", " ".join(rnd.choice(some) + "q" * rnd.randrange(3) for _ in range(rnd.randrange(30))))
            for i in range(120)] + [("none", None), ("empty", "")]
    posts = spark.createDataFrame(rows, "post_id string, post_text string").repartition(3)
    tokens = TX.text_features(posts).select("post_id", "text_words_f").cache()
    stem = {r.word: r.stem for r in TX.vocabulary_stems(tokens, "text_words_f").collect()}
    base = {r.word: r.base for r in TX.vocabulary_bases(tokens, "text_words_f").collect()}
    placed, times = defaultdict(list), defaultdict(int)
    for r in tokens.where("post_id IS NOT NULL").collect():
        placed[r.post_id] += [(i, stem[w], base[w], w in BAD_TOKENS) for i, w in enumerate(r.text_words_f)]
        times[r.post_id] += 1
    want = sorted((i, [s for _, s, _, _ in sorted(ps) if len(s) >= 3], sorted({b for _, _, b, bad in ps if not bad}))
                  for i, ps in placed.items() for _ in range(times[i]))
    assert max(times.values()) > 1
    for slots in (3, 4096):
        monkeypatch.setattr(B, "SLOTS", slots)
        for source, kept in ((posts, want), (posts.where("post_id IN ('p1', 'p2', 'none', 'empty', 'p100')"),
                                             [w for w in want if w[0] in ("p1", "p2", "none", "empty", "p100")])):
            out = text_features_normalised(source)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "_salt" not in plan and "posexplode" not in plan
            assert sorted((r.post_id, r.vector_stemmed, r.vector_lemma) for r in out.collect()) == kept
