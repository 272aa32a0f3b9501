"""Fixed values.

These strings must equal the ones the evaluated prompts were built with, or prompts and cut points
differ.  They are stated plainly and together, in their natural order.
"""

# --- fixed values: placeholder put in an unanswered assistant turn, then cut at render time ---
PLACEHOLDER = "-[[]]-this-is-really-our-highest-priority-[[]]-"

# --- fixed values: instruction prefix per dataset ---
INSTRUCTION_PREFIX = {
    "conala": (
        "Provide a self-contained Python script that solves the following problem in a markdown code block. "
        "Your solution should most likely contain a single line of code, or only a few ones."
    ),
    "mbpp": (
        "Provide a self-contained Python script that solves the following problem in a markdown code block. "
        "You are given example test cases from which you can infer the function signature."
    ),
    "apps": (
        "Provide a self-contained Python script that solves the following problem in a markdown code block. "
        "Make sure the solution obeys the constraints and passes the example test cases."
    ),
}

# --- fixed values: prompt pieces ---
FENCE = "```"
PYTHON_FENCE_OPEN = "```python\n"
TESTS_SENTENCE = " Your code should pass these tests:"
IO_MARKER_WITH_FN_NAME = "\nUse Standard Input format\n"
IO_MARKER_WITHOUT_FN_NAME = "\nUse Call-Based format\n"

# --- fixed values: stop string added to the tokenizer's end-of-sequence token ---
FENCE_STOP = "\n```\n"

# --- fixed values: per-dataset generation config (max_new_tokens, instruction field, reference field);
# any other dataset name falls back to the last row ---
DATASET_CONFIG = {
    "conala": (128, "nl", "cmd"),
    "mbpp": (512, "text", "code"),
}
DATASET_CONFIG_DEFAULT = (1024, "question", "solutions")

# --- fixed values: corpus column pairs (instruction, reference) ---
CORPUS_COLUMNS = {
    "magicoder": ("instruction", "response"),
    "magicoder_oss": ("problem", "solution"),
    "conala": ("nl", "cmd"),
    "mbpp": ("text", "code"),
    "apps": ("question", "solutions"),
}

# --- fixed values: validation sizes carved from train ---
VALIDATION_SIZE = {"magicoder": 1000, "magicoder_oss": 1000, "apps": 500}

# --- fixed values: shuffle seed, ICL seeds and sizes, sweep grid ---
SHUFFLE_SEED = 42
ICL_SEEDS = [42, 777, 5432, 55555, 97]
ICL_SIZES = [1, 2, 3]
SWEEP_GRID = {"lora_r": [8, 16, 32, 64], "lora_alpha": [16, 32, 64, 128]}

# --- fixed values: APPS difficulty slices of the response list, as (label, start, end) ---
APPS_SLICES = [("interview", 0, 3000), ("competition", 3000, 4000), ("introductory", 4000, 5000)]

# --- fixed values: ChatML markers, the default render template (a tokenizer supplies its own) ---
CHATML_OPEN = "<|im_start|>"
CHATML_CLOSE = "<|im_end|>\n"

# --- fixed values: Python's whitespace (str.isspace) as a Java regex class and its RE2 form ---
WS_CLASS_JAVA = r"[\s\x1c-\x1f\x85\p{Z}]"
WS_CLASS_RE2 = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
