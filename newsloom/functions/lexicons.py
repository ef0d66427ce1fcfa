"""Word lists that text operators need."""

from __future__ import annotations

# Polarity of news words, between -1 and 1.
POLARITY = {
    "killed": -0.85, "kill": -0.8, "death": -0.75, "died": -0.75, "dead": -0.8, "murder": -0.9, "massacre": -0.95, "genocide": -0.95, "terror": -0.85, "terrorist": -0.85,
    "attack": -0.7, "attacked": -0.7, "bombing": -0.85, "war": -0.7, "conflict": -0.55, "invasion": -0.75, "crisis": -0.7, "disaster": -0.8, "catastrophe": -0.9, "collapse": -0.75,
    "crash": -0.7, "plunge": -0.65, "plummet": -0.7, "slump": -0.6, "recession": -0.7, "bankruptcy": -0.75, "fraud": -0.8, "scandal": -0.7, "corruption": -0.75, "breach": -0.65,
    "hacked": -0.7, "ransomware": -0.75, "malware": -0.65, "vulnerability": -0.45, "exploit": -0.5, "outage": -0.55, "failure": -0.6, "lawsuit": -0.5, "sued": -0.5, "fined": -0.5,
    "penalty": -0.45, "layoffs": -0.7, "layoff": -0.7, "fired": -0.6, "resign": -0.4, "protest": -0.4, "riot": -0.7, "violence": -0.8, "victim": -0.65, "injured": -0.6,
    "wounded": -0.6, "damage": -0.55, "loss": -0.5, "losses": -0.55, "decline": -0.45, "fell": -0.4, "drop": -0.4, "warning": -0.4, "warned": -0.4, "threat": -0.6,
    "risk": -0.35, "concern": -0.3, "concerns": -0.3, "fear": -0.55, "fears": -0.55, "criticism": -0.45, "criticized": -0.5, "condemn": -0.6, "condemned": -0.6, "ban": -0.4,
    "banned": -0.45, "sanctions": -0.5, "delay": -0.3, "delayed": -0.3, "shortage": -0.5, "inflation": -0.35, "unemployment": -0.5, "corrupt": -0.75, "illegal": -0.6, "arrest": -0.5,
    "arrested": -0.5, "guilty": -0.6, "convicted": -0.6, "controversial": -0.35, "dispute": -0.4, "struggle": -0.4, "struggling": -0.45, "weak": -0.35, "weaker": -0.35, "bad": -0.5,
    "worse": -0.6, "worst": -0.75, "poor": -0.45, "negative": -0.5, "fail": -0.6, "failed": -0.65, "fails": -0.6, "failing": -0.6, "catastrophic": -0.9, "unsuccessful": -0.6,
    "lack": -0.45, "lacking": -0.45, "denied": -0.45, "denies": -0.45, "refused": -0.5, "halted": -0.5, "suspended": -0.45, "shutdown": -0.6, "recall": -0.5, "defect": -0.55,
    "flaw": -0.5, "boycott": -0.55, "downgrade": -0.55, "problem": -0.4, "problems": -0.4, "issue": -0.25, "difficult": -0.35, "breakthrough": 0.85, "record": 0.5, "surge": 0.6,
    "soar": 0.7, "soared": 0.7, "rally": 0.55, "gain": 0.5, "gains": 0.5, "rise": 0.4, "rose": 0.4, "growth": 0.55, "grew": 0.5, "profit": 0.6,
    "profits": 0.6, "revenue": 0.3, "success": 0.75, "successful": 0.7, "win": 0.65, "wins": 0.65, "won": 0.65, "victory": 0.75, "achievement": 0.7, "milestone": 0.6,
    "innovation": 0.6, "innovative": 0.6, "launch": 0.35, "launched": 0.35, "unveiled": 0.35, "improve": 0.55, "improved": 0.55, "improvement": 0.55, "boost": 0.6, "recovery": 0.6,
    "recovered": 0.55, "rebound": 0.55, "upgrade": 0.5, "approve": 0.45, "approved": 0.5, "agreement": 0.45, "deal": 0.35, "partnership": 0.45, "investment": 0.4, "funding": 0.4,
    "expansion": 0.45, "hiring": 0.45, "opportunity": 0.5, "promising": 0.6, "optimistic": 0.65, "confidence": 0.5, "strong": 0.5, "stronger": 0.55, "robust": 0.55, "excellent": 0.85,
    "outstanding": 0.8, "remarkable": 0.7, "impressive": 0.7, "good": 0.5, "better": 0.55, "best": 0.75, "positive": 0.6, "benefit": 0.5, "benefits": 0.5, "support": 0.4,
    "supported": 0.4, "praise": 0.65, "praised": 0.65, "celebrate": 0.7, "celebrated": 0.7, "peace": 0.75, "rescue": 0.6, "rescued": 0.6, "saved": 0.6, "cure": 0.8,
    "healthy": 0.6, "safe": 0.5, "safety": 0.4, "secure": 0.45, "resolved": 0.55, "solution": 0.5,
}
# Factors on the next word.
INTENSITY = {
    "very": 1.4, "extremely": 1.7, "highly": 1.4, "deeply": 1.5, "severely": 1.6, "massively": 1.6, "hugely": 1.5, "significantly": 1.4, "substantially": 1.4, "dramatically": 1.5,
    "sharply": 1.4, "strongly": 1.4, "absolutely": 1.6, "completely": 1.5, "totally": 1.5, "utterly": 1.6, "incredibly": 1.6, "particularly": 1.3, "especially": 1.3, "really": 1.3,
    "so": 1.2, "too": 1.2, "slightly": 0.6, "somewhat": 0.7, "marginally": 0.6, "barely": 0.5, "hardly": 0.5, "partially": 0.7, "relatively": 0.8, "fairly": 0.85,
    "mildly": 0.6, "moderately": 0.8,
}
# Negations, contrasts, and endings with what replaces them.
NEGATIONS = frozenset(
    "no not never none nobody nothing neither nowhere without cannot cant can't don't dont doesn't doesnt didn't didnt won't wont wouldn't shouldn't isn't isnt aren't arent wasn't weren't rarely seldom hardly barely".split()
)
CONTRASTS = frozenset("but however although though yet nevertheless nonetheless despite".split())
ENDINGS = (("ically", "e"), ("ingly", ""), ("ically", ""), ("edly", ""), ("ing", ""), ("ing", "e"), ("ies", "y"), ("ied", "y"), ("ed", ""), ("ed", "e"), ("es", ""), ("ly", ""), ("s", ""))
# What tells persons, places and organisations.
PERSON_TITLES = frozenset("Mr Mrs Ms Dr Prof President Minister Chancellor Senator Governor Mayor Judge General King Queen Prince Princess Sir Lord Lady Pope Captain Colonel Chief CEO Chairman Director Secretary Ambassador Premier".split())
PERSON_VERBS = frozenset("said says told added wrote announced argued warned denied noted".split())
PLACE_WORDS = frozenset("in at from near across".split())
ORG_WORDS = frozenset("Inc Ltd Corp Co Group Bank University Institute Ministry Department Agency Council Commission Committee Union Foundation Association Company Works Office Board Court Party Bros Holdings Partners".split())
ABBREVIATIONS = frozenset("Inc Ltd Corp Co Bros Mt St Dr Mr Mrs Ms Prof Jr Sr Gov Sen Rep Gen Col Capt Lt Sgt Ave Blvd U.S U.K U.N D.C".split())
SENTENCE_STARTERS = frozenset(
    "The A An This That These Those It He She They We You I But And Or So If When While After Before Since Because However Although Meanwhile Now Then There Here What Who How New More Most Some Many Several One Two Three "
    "Its His Her Their Our My Your Also On In At For To From By With Of As Over Under About According Following During Despite".split()
)
