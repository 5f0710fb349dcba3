"""Writes the small hand-made vocabularies of quillmill/resources; nothing is learned from data."""

import json
from pathlib import Path

OUT = Path(__file__).resolve().parents[1] / "quillmill" / "resources"
LETTERS = "abcdefghijklmnoprstuvwyzßæø"  # q and x are left out: words with them are unknown
WORDS = (
    "the of and to in is on at it as for that this with by are was an be or not from they we you he she there then than "
    "der die das und ist ein eine mit von zu den auf nicht auch aus bei wer sich sie le la les des et est un une que qui du "
    "dans pour par sur elle il de los las con por para se su al como pero si no en el una toxic value shop item "
    "http www com org page name user mail code open test data text word line list time year work life day man world"
).split()
BODIES = (
    "th he in er on at en re nd es ea ti st sh an ha or ed it to is te nt ou le ly wh io tion ing ent ble ion and ere her hat his tha "
    "eau eux aux ment aire oir que ch sch ver ung lich keit zu ein aus en es er em ie ei au os as ar al ado ida cion mente"
).split()
MERGES = (
    "t h|th e|i n|e r|a n|o n|r e|e s|a t|e n|o r|t i|ti on|an d|in g|e d|i t|o u|l e|i s|s t|n t|b le|l y|w h|s h|h a|u n|d e|r i|s e|m en|"
    "men t|q u|qu e|c h|Ġ the|Ġ of|Ġ and|Ġ t|Ġ a|Ġ in|er e|th at|Ġ that|Ã ¤|Ã ©|Ã ¨|a u|e au|u x|Ċ T|l a|d i|d u|i e|ei n|o s"
)


def main() -> None:
    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
    tokens += [c for c in "0123456789!\"#%&'()*+,-./:;<=>?@[]_`{|}~"]
    tokens += list(LETTERS) + ["##" + c for c in LETTERS + "0123456789"]
    tokens += WORDS + BODIES + ["##" + b for b in BODIES]
    tokens = list(dict.fromkeys(tokens))
    (OUT / "vocab.txt").write_text("\n".join(tokens) + "\n", encoding="utf-8")
    pairs = [tuple(p.split(" ")) for p in MERGES.split("|")]
    made, kept = set(), []
    for a, b in pairs:  # each side a character or made before, each product once
        if all(len(x) == 1 or x in made for x in (a, b)) and a + b not in made:
            made.add(a + b)
            kept.append((a, b))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = [chr(b) for b in plain if chr(b) not in "$^"] + [chr(256 + i) for i in range(68)]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(symbols + [a + b for a, b in kept]))}
    (OUT / "bpe_vocab.json").write_text(json.dumps(vocab, ensure_ascii=False), encoding="utf-8")
    (OUT / "merges.txt").write_text("#version: hand-made\n" + "\n".join(f"{a} {b}" for a, b in kept) + "\n", encoding="utf-8")
    print(len(tokens), len(vocab), len(kept))


if __name__ == "__main__":
    main()
