"""Stand-ins for a caller's model in the hook queries; imported by Python workers."""


def model():
    return {"vowels": set("aeiou")}


def annotate(model, batch):
    counts = [sum(c in model["vowels"] for c in text) for text in batch["text"]]
    return batch[["doc_id"]].assign(vowels=counts)


def row(model, text):
    if len(text) % 5 == 0:
        raise ValueError("row cannot be read")
    return {"vowels": sum(c in model["vowels"] for c in text)}


def embed(model, texts):
    return texts.map(lambda t: [float(sum(c == v for c in t)) for v in sorted(model["vowels"])])
