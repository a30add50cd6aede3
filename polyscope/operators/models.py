"""The boundary to models and their processors: what is configured, what is loaded, and once for each worker only."""

from __future__ import annotations

from collections.abc import Callable

#: A model takes an input row and gives raw_output, and may give rendered_prompt, prompt_token_count and output_token_count.
Model = Callable[[dict], dict]
#: A processor takes an input row and gives text_tokens, total_sequence_length and visual_grid_tokens (null without images).
Processor = Callable[[dict], dict]

REGISTRY: dict[str, Callable[[dict], Callable[[], Model]]] = {}
PROCESSORS: dict[str, Callable[[dict], Callable[[], Processor]]] = {}

# The names of number formats in model configurations, and what they stand for.
DTYPES = {"bfloat16": "bfloat16", "bf16": "bfloat16", "float16": "float16", "fp16": "float16", "float32": "float32", "fp32": "float32"}
# The keys of a processor's settings, and the packages whose versions a result names.
PROCESSOR_KEYS = ("min_pixels", "max_pixels")
PACKAGES = ("torch", "transformers", "accelerate", "qwen-vl-utils", "flash-attn")


def dtype_of(name: str) -> str:
    """The number format that a name stands for; another name is an error."""
    if name not in DTYPES:
        raise KeyError(f"unknown number format: {name}")
    return DTYPES[name]


def given(settings: dict | None) -> dict:
    """The settings that have a value."""
    return {k: v for k, v in (settings or {}).items() if v is not None}


def set_of(argument: str | None) -> set[str] | None:
    """What a comma-separated argument names, spaces and all; none where there is none."""
    return set(argument.split(",")) if argument else None


def hook_description(layer: int, location: str = "block_output", positions: str = "last_token") -> str:
    """Where an intervention hooks in."""
    return "; ".join(f"{k}={v}" for k, v in (("layer", layer), ("location", location), ("positions", positions)))


def registered(name: str, into: dict | None = None) -> Callable:
    """Registers what makes a loader from a configuration; the loader runs on a worker and returns the model."""

    def add(make: Callable) -> Callable:
        (REGISTRY if into is None else into)[name] = make
        return make

    return add


def loader(config: dict, registry: dict | None = None) -> Callable[[], Callable]:
    """The loader that a configuration asks for by ``adapter``, or by its model_id."""
    registry = REGISTRY if registry is None else registry
    for name in (config.get("adapter"), config.get("model_id"), "transformers"):
        if name in registry:
            return registry[name](config)
    raise KeyError(f"no adapter for {config.get('adapter') or config.get('model_id')}")


@registered("fixed_label")
def fixed_label(config: dict) -> Callable[[], Model]:
    """Always the same answer: for dry runs of the whole path, and as a baseline."""
    label = config.get("label", "A")

    def load() -> Model:
        return lambda row: {"raw_output": label, "rendered_prompt": row["prompt"], "prompt_token_count": len(row["prompt"].split()), "output_token_count": 1}

    return load


@registered("word_count", PROCESSORS)
def word_count(config: dict) -> Callable[[], Processor]:
    """Counts words for tokens and one token for each image: for use without a tokenizer's files."""

    def load() -> Processor:
        def process(row: dict) -> dict:
            n, images = len(row["prompt"].split()), len(row["image_paths"])
            return {"text_tokens": n, "total_sequence_length": n + images, "visual_grid_tokens": images or None}

        return process

    return load


@registered("tokenizer_file", PROCESSORS)
def tokenizer_file(config: dict) -> Callable[[], Processor]:
    """Counts the tokens of a tokenizer's file, and for each image of known size one token for every ``patch`` x ``patch`` pixels."""

    def load() -> Processor:
        from tokenizers import Tokenizer

        tokenizer, patch = Tokenizer.from_file(config["tokenizer_file"]), int(config.get("patch", 28))

        def process(row: dict) -> dict:
            n = len(tokenizer.encode(row["prompt"], add_special_tokens=False).ids)
            sizes = [(x["width"], x["height"]) for x in row.get("image_info") or [] if x["width"] and x["height"]]
            grid = sum(-(-w // patch) * -(-h // patch) for w, h in sizes) if sizes else None
            return {"text_tokens": n, "total_sequence_length": n + (grid or 0), "visual_grid_tokens": grid}

        return process

    return load


def parts(config: dict) -> tuple[dict, dict]:
    """The settings of a pretrained model and of its processor."""
    model = given({"revision": config.get("revision"), "dtype": dtype_of(config.get("dtype", "bfloat16")), "device_map": config.get("device_map", "auto"), "attn_implementation": config.get("attn_implementation") or None})
    return model, given({"revision": config.get("revision"), **{k: config.get(k) for k in PROCESSOR_KEYS}})


@registered("transformers")
def transformers_model(config: dict) -> Callable[[], Model]:
    """A vision-language model of the transformers package, which must be installed where workers run, with its weights."""
    settings, processing = parts(config)
    generation = given(config.get("generation"))

    def load() -> Model:
        import torch
        import transformers

        processor = transformers.AutoProcessor.from_pretrained(config["model_id"], **processing)
        kind = getattr(transformers, "AutoModelForImageTextToText", None) or transformers.AutoModelForVision2Seq
        model = kind.from_pretrained(config["model_id"], **{k: v for k, v in settings.items() if k != "dtype"}, torch_dtype=getattr(torch, settings["dtype"]))

        def answer(row: dict) -> dict:
            from PIL import Image

            content = [{"type": "image"} for _ in row["image_paths"]] + [{"type": "text", "text": row["prompt"]}]
            prompt = processor.apply_chat_template([{"role": "user", "content": content}], tokenize=False, add_generation_prompt=True)
            images = [Image.open(p).convert("RGB") for p in row["image_paths"]] or None
            tokens = processor(text=[prompt], images=images, padding=True, return_tensors="pt").to(model.device)
            asked = tokens["input_ids"].shape[1]
            with torch.inference_mode():
                new = model.generate(**tokens, **generation)[:, asked:]
            text = processor.batch_decode(new, skip_special_tokens=True, clean_up_tokenization_spaces=False)[0]
            return {"raw_output": text.strip(), "rendered_prompt": prompt, "prompt_token_count": int(asked), "output_token_count": int(new.shape[1])}

        return answer

    return load


def placeholder(config: dict) -> Callable[[], Model]:
    """A model that is only named so far."""

    def load() -> Model:
        raise NotImplementedError(f"no adapter yet for {config.get('model_id')}")

    return load


for _name in ("internvl", "showui"):
    REGISTRY[_name] = placeholder
