"""Fixed word and symbol tables.

Everything in this module is data, not logic.  The lists marked FIXED VALUES
must stay exactly as written (same entries, same order, duplicates kept) so that
results match the analysis this library re-creates.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: Spark ML's default English stop-word list
# (StopWordsRemover.loadDefaultStopWords("english"), 181 words).
# ---------------------------------------------------------------------------
STOP_WORDS_EN: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he
    him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can
    will just don should now i'll you'll he'll she'll we'll they'll i'd you'd
    he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
    doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot
    could here's how's let's ought that's there's what's when's where's who's
    why's would
    """.split()
)

# ---------------------------------------------------------------------------
# FIXED VALUES: tokens dropped before lemmatisation.
# ---------------------------------------------------------------------------
BAD_TOKENS: tuple[str, ...] = ("rd", "th", "h", "cet")

# ---------------------------------------------------------------------------
# FIXED VALUES: emoji code-point ranges (inclusive) used to extract emoji.
# ---------------------------------------------------------------------------
EMOJI_RANGES: tuple[tuple[int, int], ...] = (
    (0x1F300, 0x1F5FF),
    (0x1F600, 0x1F64F),
    (0x1F680, 0x1F6FF),
    (0x2600, 0x26FF),
    (0x2700, 0x27BF),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: positive emoji / emoticon symbols, matched as substrings.
# Kept verbatim, including the duplicated ':>' and the entry '((:d:' that is
# two adjacent literals fused into one.  Several emoticons use U+2011
# (non-breaking hyphen) rather than an ASCII hyphen.
# ---------------------------------------------------------------------------
POSITIVE_SYMBOLS: tuple[str, ...] = (
    '😍', '❤', '🔥', '🙌', '😂', '♥', '👌', '😎', '👍', '🎉', '🙏', '👏', '😁', '♡',
    '😘', '😻', '✌', '😊', '😏', '💙', '💕', '😉', '💜', '🙈', '💖', '💪', '💥', '😄',
    '💚', '💛', '😃', '😜', '💯', '💃', '😆', '😝', '💓', '💞', '🖤', '😋', '💗', '😀',
    '😅', '💘', '😇', '😬', '💟', '❣', '😛', '🎊', '👻', '🙂', '👯', '😚', '🍻', '✔',
    '🙃', '🕺', '✅', '😗', '😙', '😸',
    ':‑)', ':)', ':-]', ':]', ':-3', ':3', ':>', ':>', '8-)', '8)', ':-}', ':}',
    ':-P', ':o)', ':c)', ':^)', '=]', '=)', ':‑D', ':D', '8‑D', '8D', 'x‑D', 'xD',
    'X‑D', 'XD', '=D', '=3', 'B^D', ':-))', ":'‑)", ":')'", ':-*', ':*', ":×'",
    ';‑)', ';)', '*-)', '*)', ';‑]', ';]', ';^)', ':‑,', ';D', ':‑P', ':P', 'X‑P',
    'XP', 'x‑p', 'xp', ':‑p', ':p', ':‑Þ', ':Þ', ':‑þ', ':þ', ':‑b', ':b', '((:d:',
    '=p', ">:P'", 'O:‑)', 'O:)', '0:‑3', '0:3', '0:‑)', '0:)', "0;^)'", '>:‑)',
    '>:)', '}:‑)', '}:)', '3:‑)', '3:)', '>;)', '>:3', '>;3', '<3', ":')",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: negative emoji / emoticon symbols, matched as substrings.
# ---------------------------------------------------------------------------
NEGATIVE_SYMBOLS: tuple[str, ...] = (
    '😭', '😢', '😱', '😩', '💔', '😔', '😫', '👊', '😞', '😥', '😒', '😓', '😡', '😲',
    '😣', '😕', '😰', '😵', '☹', '😤', '😨', '😿', '😯', '😖', '😠', '🙁', '👎', '🙀',
    '😦', '😧', '😟', '😾', '👿',
    ':(', ':/', ':[', ':<', ':,(',
)

# ---------------------------------------------------------------------------
# Default verb-lemma dictionary (surface form -> base form).  A stand-in for a
# full lexical database, which is not available here: irregular verb forms and
# the auxiliaries that survive stop-word removal.  Callers with a real
# dictionary pass it as a table instead (see operators.text.normalise_vocabulary).
# ---------------------------------------------------------------------------
VERB_LEMMAS: dict[str, str] = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be",
    "has": "have", "had": "have", "having": "have",
    "does": "do", "did": "do", "done": "do", "doing": "do",
    "went": "go", "gone": "go", "goes": "go", "going": "go",
    "made": "make", "makes": "make", "making": "make",
    "said": "say", "says": "say", "saying": "say",
    "got": "get", "gets": "get", "getting": "get", "gotten": "get",
    "took": "take", "taken": "take", "takes": "take", "taking": "take",
    "saw": "see", "seen": "see", "sees": "see", "seeing": "see",
    "came": "come", "comes": "come", "coming": "come",
    "knew": "know", "known": "know", "knows": "know", "knowing": "know",
    "thought": "think", "thinks": "think", "thinking": "think",
    "gave": "give", "given": "give", "gives": "give", "giving": "give",
    "found": "find", "finds": "find", "finding": "find",
    "told": "tell", "tells": "tell", "telling": "tell",
    "felt": "feel", "feels": "feel", "feeling": "feel",
    "left": "leave", "leaves": "leave", "leaving": "leave",
    "kept": "keep", "keeps": "keep", "keeping": "keep",
    "began": "begin", "begun": "begin", "begins": "begin",
    "brought": "bring", "brings": "bring", "bringing": "bring",
    "wrote": "write", "written": "write", "writes": "write", "writing": "write",
    "ran": "run", "runs": "run", "running": "run",
    "met": "meet", "meets": "meet", "meeting": "meet",
    "paid": "pay", "pays": "pay", "paying": "pay",
    "heard": "hear", "hears": "hear", "hearing": "hear",
    "danced": "dance", "dances": "dance", "dancing": "dance",
    "loved": "love", "loves": "love", "loving": "love",
    "played": "play", "plays": "play", "playing": "play",
    "sang": "sing", "sung": "sing", "sings": "sing", "singing": "sing",
    "won": "win", "wins": "win", "winning": "win",
    "lost": "lose", "loses": "lose", "losing": "lose",
    "bought": "buy", "buys": "buy", "buying": "buy",
    "sold": "sell", "sells": "sell", "selling": "sell",
    "stood": "stand", "stands": "stand", "standing": "stand",
    "understood": "understand", "understands": "understand",
}

# ---------------------------------------------------------------------------
# Default polarity lexicon (word -> polarity in [-1, 1]).  Small hand-made
# table; numeric equality with any external sentiment library is not claimed.
# Callers pass their own lexicon table for real use.
# ---------------------------------------------------------------------------
POLARITY_LEXICON: dict[str, float] = {
    "amazing": 0.6, "awesome": 1.0, "beautiful": 0.85, "best": 1.0, "better": 0.5,
    "brilliant": 0.9, "cool": 0.35, "excellent": 1.0, "fantastic": 0.4, "fun": 0.3,
    "glad": 0.5, "good": 0.7, "great": 0.8, "happy": 0.8, "incredible": 0.9,
    "love": 0.5, "lovely": 0.5, "nice": 0.6, "perfect": 1.0, "wonderful": 1.0,
    "wow": 0.1, "yes": 0.0, "thanks": 0.2, "thank": 0.2, "magic": 0.4,
    "awful": -1.0, "bad": -0.7, "boring": -1.0, "disappointing": -0.6, "hate": -0.8,
    "horrible": -1.0, "poor": -0.4, "sad": -0.5, "terrible": -1.0, "ugly": -0.7,
    "worse": -0.4, "worst": -1.0, "wrong": -0.5, "angry": -0.5, "never": -0.1,
}
