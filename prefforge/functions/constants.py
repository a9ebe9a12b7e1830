"""Fixed values that results must agree on."""

from __future__ import annotations

# Names of judge objectives, failure modes and phrases, and default thresholds.
OBJECTIVE_FIELDS = [
    "fidelity",
    "visual_specificity",
    "style_fit",
    "composition_lighting",
    "non_genericness",
    "coherence",
    "brevity_control",
    "anti_magic_word_score",
]
CORE_FIELDS = ["fidelity", "style_fit", "non_genericness", "anti_magic_word_score"]
ALLOWED_FAILURE_MODES = ["none", "magic_words", "irrelevant_artist", "restatement", "off_topic", "contradiction", "too_generic", "too_verbose", "incoherent"]
HARD_FAILURE_MODES = ["magic_words", "irrelevant_artist", "off_topic", "contradiction", "incoherent"]
GENERIC_FAILURE_MODES = ["too_generic", "restatement", "too_verbose"]
MAGIC_WORDS = [
    "8k", "4k", "artstation", "trending on artstation", "octane render", "unreal engine", "unreal engine 5", "masterpiece",
    "ultra detailed", "ultradetailed", "hyper detailed", "highly detailed", "award winning", "cinematic lighting", "hd",
]
ARTIST_WORDS = ["greg rutkowski", "artgerm", "wlop", "alphonse mucha", "makoto shinkai", "beeple", "loish", "rossdraws"]
SEPARATOR = "</s>"
END_OF_TEXT = "<|endoftext|>"
NO_OBJECT = "_no_object"
NSFW_WARNING = "There were naughty dreams that had to be popped"
#: Least scores of a chosen candidate: of the strict (greedy) and of the loose (priority) pair builder.
STRICT_GUARDRAILS = {"fidelity": 6, "style_fit": 5, "non_genericness": 6, "anti_magic_word_score": 7, "coherence": 6}
LOOSE_GUARDRAILS = {"fidelity": 5, "style_fit": 4, "non_genericness": 5, "anti_magic_word_score": 6, "coherence": 5}
#: Weights of the overall score that the judge is asked for.
OVERALL_WEIGHTS = {"fidelity": 0.25, "visual_specificity": 0.20, "style_fit": 0.15, "composition_lighting": 0.15, "non_genericness": 0.15, "coherence": 0.10}
COST_PER_1000_TOKENS = 0.02
IGNORED_LABEL = -100

# Formats of chat-bot messages.
DONE_WORD = "Dreamt"
COMMAND = "/dream prompt:"
AUTHOR_MARK = "for @"
AUTHOR_END = "... "
WARNING_MARK = "\n**WARNING:**"
NEGATIVE_ARGUMENT = "negative_prompt:"
NEGATIVE_MARKS = ["negative prompt", "negative _ prompt", "negative_prompt"]
SCALE_MARK = "cfg _ scale"
ARGUMENT_MARK = "--"
LONGEST_MIDDLE_ARGUMENT = 20
STATUS_TEXT = "dreamt in"
STATUS_START = "dreaming for"
BRACKETS = "()[]{}|"
EDGE_CHARACTERS = ": ='.,\""
# Patterns of the cleaning steps, in Java's syntax.
ARGUMENTS = r"(?d) [^ ]*:.*"
LOOSE_DIGITS = r"(?U)(?<=\d)\s(?=\d|[KkdDs][^\w]|[KkdDs]$)"
SPACE_BEFORE_COMMA = r"(?U)\s,"
# Patterns of judge replies.
FENCE_BEGIN = r"```(?:json)?\s*"
FENCE_END = "```"
FLAT_OBJECT = r"\{[^{}]*\}"
REASON_IN_PROSE = r'"?reason"?\s*[:=]\s*"([^"]*)"'
SCORE_IN_PROSE = r'"?score"?\s*[:=]\s*(\d+)'
OVERALL_IN_PROSE = r'"?(?:overall|score)"?\s*[:=]\s*(\d+)'
# Formats of training texts and names.
SFT_BEGIN, SFT_MIDDLE, SFT_END = "[BOS]", " = ", "<endoftext>"
CHECKPOINT_FORMAT = "step-%06d"
