"""Task sets, word lists, tags, titles and texts.

Everything in this module is data that has to equal the published workflow's
values for results to agree; the logic that uses it lives elsewhere.
"""

# The task families.
BOOL_TASKS = (
    "property_prediction-sider",
    "property_prediction-hiv",
    "property_prediction-clintox",
    "property_prediction-bbbp",
)
NUM_TASKS = ("property_prediction-lipo", "property_prediction-esol")
FORMULA_TASKS = ("name_conversion-s2f", "name_conversion-i2f")
IUPAC_TASKS = ("name_conversion-s2i",)
SMILES_TASKS = (
    "retrosynthesis",
    "name_conversion-i2s",
    "molecule_generation",
    "forward_synthesis",
)
CAPTION_TASK = "molecule_captioning"
TEXT_TASKS = FORMULA_TASKS + IUPAC_TASKS
ALL_TASKS = BOOL_TASKS + NUM_TASKS + TEXT_TASKS + SMILES_TASKS + (CAPTION_TASK,)

# Votes counted in free text, by substring.
YES_KEYWORDS = (
    "yes", "true", "correct", "positive", "active", "inhibitory",
    "toxic", "permeable", "soluble", "effective",
)
NO_KEYWORDS = (
    "no", "false", "incorrect", "negative", "inactive", "non-inhibitory",
    "non-toxic", "not permeable", "insoluble", "ineffective", "not",
)
# Short answers taken literally.
YES_EXACT = ("yes", "true", "1", "correct", "positive")
NO_EXACT = ("no", "false", "0", "incorrect", "negative")
YES_BOLD = ("yes", "true", "correct", "positive", "active")
NO_BOLD = ("no", "false", "incorrect", "negative", "inactive")
# Phrases that introduce an answer.
ANSWER_MARKERS = (
    "answer", "final answer", "conclusion", "result",
    "therefore", "thus", "in summary",
)
# Words for an unbounded number, and its stand-in.
UNBOUNDED_WORDS = ("infinite", "infinity", "inf", "undefined", "undef")
UNBOUNDED_VALUE = "2147483647"

THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"

# Rows kept per task.
TASK_QUOTAS = {
    "forward_synthesis": 1349,
    "molecule_captioning": 6,
    "molecule_generation": 908,
    "name_conversion-i2f": 223,
    "name_conversion-i2s": 46,
    "name_conversion-s2f": 2906,
    "name_conversion-s2i": 10,
    "property_prediction-bbbp": 3344,
    "property_prediction-clintox": 2182,
    "property_prediction-esol": 2350,
    "property_prediction-hiv": 5498,
    "property_prediction-lipo": 9614,
    "property_prediction-sider": 23416,
    "retrosynthesis": 105,
}

# Titles that precede a molecule string, in the order they are tried.
FORWARD_TITLE = "Predicted product SMILES:"
RETRO_TITLES = (
    "Reactant SMILES:",
    "the predicted reactant molecules based on the product SMILES:",
    "Here are the predicted reactant molecules in SMILES format:",
    "Reactants SMILES:",
    "Reactants:",
    "the predicted reactants for the given product SMILES:",
    "Here are the predicted reactants for the given product molecule:",
    "following reactants:",
    "Here are the predicted reactants for the given product molecule using the SMILES representation:",
    "The predicted reactants for the given product molecule are:",
    "the predicted reactants based on the product SMILES:",
    "the predicted reactants for the given product:",
    "the predicted reactants for the given reaction:",
)
RETRO_MULTI_TITLES = (
    "predicted reactants for each product SMILES:",
    "the predicted reactants for each product:",
    "the predicted reactants for each product molecule:",
    "Here are the predicted reactants for the given product molecules:",
)
RETRO_SECOND = "product 2:"
GENERATION_TITLES = (
    "SMILES for the second molecule: ",
    "the second input:",
    " is:",
    "molecules:",
    "description:",
    "you described:",
    "SMILES:",
    "described in the input:",
    "Here is the SMILES representation of the molecule:",
    "you provided:",
    "the molecule is:",
)

# Markers removed from assistant text, in removal order.
MARKERS_WITH_TAGS = (
    "<|endoftext|>", "<|im_start|>", "<|im_end|>",
    "<|object_ref_start|>", "<|object_ref_end|>", "<|box_start|>",
    "<|box_end|>", "<|quad_start|>", "<|quad_end|>",
    "<|vision_start|>", "<|vision_end|>", "<|vision_pad|>",
    "<|image_pad|>", "<|video_pad|>",
    "<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>",
    "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "<|fim_pad|>",
    "<|repo_name|>", "<|file_sep|>",
    "<think>", "</think>",
    "<SMILES>", "</SMILES>", "<SELFIES>", "</SELFIES>",
    "<IUPAC>", "</IUPAC>", "<FASTA>", "</FASTA>",
    "<IMG_CONTEXT>", "<img>", "</img>", "<quad>", "</quad>",
    "<ref>", "</ref>", "<box>", "</box>",
    "<|action_start|>", "<|action_end|>", "<|interpreter|>", "<|plugin|>",
    "<video>",
)
MARKERS_KEEP_TAGS = (
    "<|endoftext|>", "<|im_start|>", "<|im_end|>",
    "<|object_ref_start|>", "<|object_ref_end|>", "<|box_start|>",
    "<|box_end|>", "<|quad_start|>", "<|quad_end|>",
    "<|vision_start|>", "<|vision_end|>", "<|vision_pad|>",
    "<|image_pad|>", "<|video_pad|>",
    "<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>",
    "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "<|fim_pad|>",
    "<|repo_name|>", "<|file_sep|>",
    "<SELFIES>", "</SELFIES>", "<FASTA>", "</FASTA>",
    "<IMG_CONTEXT>", "<image>", "</image>", "<img>", "</img>",
    "<quad>", "</quad>", "<ref>", "</ref>", "<box>", "</box>",
    "<|action_start|>", "<|action_end|>", "<|interpreter|>", "<|plugin|>",
    "<video>", "</video>",
)

# Translation.
OUTPUT_ONLY_SENTENCE = (
    "Please remember to output only the translation, without any additional "
    "explanation or commentary."
)
LOW_RESOURCE_LANGS = ("bn", "te", "sr", "th", "vi", "hu", "cs")
REPORT_LANGS = (
    "hu", "vi", "es", "cs", "fr", "de", "ru", "bn",
    "sr", "ko", "ja", "ar", "th", "sw", "zh", "te",
)

# Leading tokens of an empty rationale, and rank thresholds and bins.
EMPTY_THINK_TOKENS = ("<think>", "\n\n", "</think>", "\n\n")
RANK_THRESHOLDS = (1, 5, 10, 50, 100, 500, 1000)
RANK_BIN_EDGES = (0.5, 1.5, 5.5, 10.5, 50.5, 100.5, 500.5, 1000.5, 10000.5)
RANK_BIN_LABELS = ("1", "2-5", "6-10", "11-50", "51-100", "101-500", "501-1K", "1K+")

# Upsampling regime.
UPSAMPLE_TARGET = 500_000
UPSAMPLE_COPIES = 3
