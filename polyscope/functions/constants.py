"""The benchmark's fixed values."""

# Language codes and answer labels, in this order.
LANGUAGES = ("en", "zh", "fr", "ru", "ja", "th")
LABELS = ("A", "B", "C", "D")
# Dimensions and the prefix of their files.
DIMENSION_PREFIXES = {"wf": "wf", "wi": "wi", "au": "au", "ap": "ap", "ael": "abs_el", "rel": "rel_el", "ri": "knowledge_rich", "si": "knowledge_sparse"}
EPISODE_DIMENSIONS = ("ri", "si")
# Weights of dimensions in the weighted accuracy.
DIMENSION_WEIGHTS = {"wf": 1.0, "wi": 1.0, "au": 1.0, "ap": 1.0, "ael": 1.0, "rel": 1.0, "ri": 1.5, "si": 2.0}
# Counts of the public release, and rows per language that were published.
RELEASE_COUNTS = {"manifest_rows": 13470, "rows_per_language": 2245, "parallel_ids": 2245, "languages_per_parallel_id": 6, "directed_pairs": 67350, "canonical_inputs": 13470, "mismatch_inputs": 67350}
PUBLISHED_ROWS_PER_LANGUAGE = 2156
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
# Prompt templates by profile.
LABEL_INSTRUCTION = "Respond with exactly one label: A, B, C, or D."
TASK_INSTRUCTION = "You are given a GUI screenshot and a multiple-choice question. Select the single best answer."
PROMPT_PROFILES = ("mpr_minimal_v1", "mpr_label_only_v1", "mpr_direct_v1")
