"""Class names, column spellings, reply texts, thresholds.

These must equal the reference application's values for equal results, so
they are kept here verbatim, in their natural order, in one place.
"""

# --- fixed values: toxicity classes -----------------------------------------
# Column spellings of the seven classes (ledger, history, score columns).
CLASSES = ["toxic", "severe_toxic", "obscene", "identity_attack", "insult",
           "threat", "sexual_explicit"]
# Human names, same order (reports, scorer output keys).
CLASSES_HUMAN = ["Toxic", "Severely Toxic", "Obscene", "Identity Attack", "Insult",
                 "Threat", "Sexually Explicit"]
# The training data spells the second class differently; renamed on ingest.
TRAINING_TOXICITY_COLUMNS = ["toxic", "severe_toxicity", "obscene", "identity_attack",
                             "insult", "threat", "sexual_explicit"]
# Identity-group label columns of the training data (nullable).
IDENTITY_COLUMNS = ["asian", "atheist", "bisexual", "black", "buddhist", "christian",
                    "female", "heterosexual", "hindu", "homosexual_gay_or_lesbian",
                    "intellectual_or_learning_disability", "jewish", "latino", "male",
                    "muslim", "other_disability", "other_gender",
                    "other_race_or_ethnicity", "other_religion",
                    "other_sexual_orientation", "physical_disability",
                    "psychiatric_or_mental_illness", "transgender", "white"]
# Reaction counts of the training data.
REACTION_COLUMNS = ["funny", "wow", "sad", "likes", "disagree"]

# --- fixed values: thresholds and limits -------------------------------------
THRESHOLD = 0.5            # a class counts when its score is strictly above this
TIER_REPLY_MIN = 4         # classes over threshold for a written reply
TIER_REACT_MIN = 2         # classes over threshold for a reaction
COMMAND_PREFIX = "%"       # messages starting with it are commands, not scored
IMAGE_PREFIXES = ["toxic show me ", "toxicbot show me "]
APOLOGY_TOKEN = "sorry"
APOLOGY_SUBSTRING = "toxic"
WHY_MAX_CHARS = 100        # longer texts are cut to 97 characters + "..."
WHY_CUT_CHARS = 97
AWARD_EMOJIS = ["🎖", "🏅", "🥇"]
AWARD_PROBABILITY = 0.1
FAILED_RATE = "My brain hurts"
NOT_FOUND_PREFIX = "Sorry "
NOT_FOUND_SUFFIX = ", I didn't find your last message here"
AWARD_REPLY = "Thanks for the gold, kind stranger!"
IDENTITY_REACTION = "<pepocringe:746992858535297044>"
PLAIN_REACTION = "<cathands:755262972204679279>"

# Image request defaults and guard.
IMAGE_DEFAULTS = {"h": 256, "w": 256, "scale": 5.0, "ddim_steps": 30,
                  "n": 8, "cond_scale": 10.0}
IMAGE_MAX_PIXELS = 524288
IMAGE_MAX_STEPS = 250

# --- fixed values: reply lists of the sample configuration -------------------
TOXIC_REPLIES = [
    "Bro chill",
    "Hey that's uncalled for!",
    "Lol good one",
    "Be kind to others",
    "Why are you so mean?",
    "Try to be better",
]
APOLOGY_REPLIES = [
    "It's ok I forgive you",
    "You went a little too far this time... but I forgive you",
    "Ok.",
    "It's alright buddy, we all have bad days",
    "I don't forgive you, but I'm proud of you for accepting responsibility",
    "Sorries are cheap, show me with your actions",
    "I know you're better than that, so I'll overlook this for now",
]
PERSONA_P_DEFAULT = 0.2

# The reply to a request whose image was flagged (fixed value).
SAFETY_MESSAGE = "😳 Sorry but I can't show you this!"

# BPE special tokens, in id order ([UNK] is id 0).
SPECIAL_TOKENS = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"]
