"""Word lists (fixed values)."""

# The public English list of Spark's StopWordsRemover.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her "
    "hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s "
    "t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd "
    "they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't "
    "weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't "
    "couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would"
).split()

# Words that carry no information in alert text.
ALERT_STOP_WORDS = "weather national service alert warning advisory watch issued".split()

STOP_WORDS = ENGLISH_STOP_WORDS + ALERT_STOP_WORDS

URGENCY_WORDS = ["immediate", "urgent", "emergency", "warning"]

# A small default lexicon: word -> (polarity, subjectivity).
DEFAULT_LEXICON = {
    "calm": (0.3, 0.75),
    "clear": (0.1, 0.4),
    "safe": (0.5, 0.5),
    "good": (0.7, 0.6),
    "great": (0.8, 0.75),
    "better": (0.5, 0.5),
    "improving": (0.4, 0.4),
    "mild": (0.3, 0.5),
    "light": (0.4, 0.7),
    "minor": (-0.05, 0.2),
    "moderate": (0.0, 0.3),
    "significant": (0.4, 0.9),
    "considerable": (0.1, 0.4),
    "high": (0.15, 0.55),
    "heavy": (-0.2, 0.5),
    "bad": (-0.7, 0.65),
    "poor": (-0.4, 0.6),
    "worse": (-0.4, 0.6),
    "severe": (-0.5, 0.6),
    "extreme": (-0.15, 1.0),
    "dangerous": (-0.6, 0.9),
    "deadly": (-0.2, 0.4),
    "catastrophic": (-0.8, 0.9),
    "destructive": (-0.6, 0.7),
    "damaging": (-0.5, 0.6),
    "threat": (-0.4, 0.5),
    "threatening": (-0.5, 0.6),
    "emergency": (-0.4, 0.5),
    "urgent": (-0.3, 0.6),
    "hazardous": (-0.5, 0.7),
    "icy": (-0.3, 0.5),
    "cold": (-0.6, 1.0),
    "hot": (0.25, 0.85),
    "worthless": (-0.8, 0.9),
    "stupid": (-0.8, 1.0),
    "hate": (-0.8, 0.9),
}
