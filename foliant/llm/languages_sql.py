"""An independent SQL reading of line languages, by function words and scripts, to hold the model's answers against."""

from __future__ import annotations

from foliant.llm.language import LABELS, LANGUAGES

# Common words of each language in Latin letters; a word of several languages counts for each a part.
WORDS = {
    "en": "the and is on to of at as if for by be with from are was not in it that this which has have been before after any one its can a an when two low report reports ready new driven each while",
    "de": "der die das und von wird an nicht auf zu ist noch nach mit im in den dem des ein eine einer bei beim für als auch sich wir wenn oder wie es er sie zum zur am bis durch über nur zwischen haben drei vor",
    "fr": "le la les l est et du au aux des un une sur ne pas dans par que qui en pour d il elle ce cette se sans à été être plus avec ou on nous sont si avant bien reste fin chaque fois deux premier entre trois dès tant zéro pendant sait pourquoi alimentation tout toute leur après",
    "es": "el la los las y de no al del por una un en que es se con para está ha hay sin su lo como más hemos si cuando desde hasta tras antes después sabe alguien dos primer entre tres final cada queda veces algo",
    "pt": "o a os as em do da dos das não um uma é que para ao à no na se por com de foi ser pelo pela mais está sem seu já quando até ou entre três fim antes depois primeiro durante alguém duas vezes fica assim",
    "it": "il lo la gli i di non che è per un una del della viene si con le nel da al dal su più sono ha ogni dopo prima perché e o se come alla dei abbiamo tra tre sta finché ci due primo resta alle",
    "nl": "het de van op niet als naar een is in te dat wordt met en nog voor bij aan of uit om we na er zijn door tot over want deze die heeft moet iemand waarom twee tijdens eerste blijft keer nul weet tussen drie",
}


def sql() -> str:
    sets = {lang: set(words.split()) for lang, words in WORDS.items()}
    rows = ", ".join(f"('{lang}', '{w}', {1 / sum(w in s for s in sets.values()):.6f})" for lang, s in sets.items() for w in sorted(s))
    names = ", ".join(f"('{a}', '{b}')" for a, b in LABELS.items())
    order = ", ".join(f"('{lang}', {i})" for i, lang in enumerate(LANGUAGES))
    return rf"""
        WITH s(lang, word, weight) AS (VALUES {rows}), m(name, code) AS (VALUES {names}), o(lang, nth) AS (VALUES {order}),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
        p AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '[A-Za-z]*[0-9_][A-Za-z0-9_]*', ' ', 'g'), '[A-Z]{{2,}}', ' ', 'g') AS said, line FROM l WHERE length(trim(line)) >= 20),
        c AS (SELECT *, CASE WHEN regexp_matches(said, '[\p{{L}}]{{2}}|\p{{Han}}') THEN said WHEN len(regexp_extract_all(line, '[\p{{L}}]+')) >= 4 AND NOT regexp_matches(line, '[0-9_]') THEN line ELSE '' END AS prose FROM p),
        w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(prose), '[\p{{L}}]+')) AS word FROM c),
        v AS (SELECT doc_id, line_no, lang, sum(weight) AS score FROM w JOIN s USING (word) GROUP BY ALL),
        b AS (SELECT doc_id, line_no, arg_max(lang, score) AS best FROM v GROUP BY ALL),
        g AS (SELECT doc_id, line_no, length(regexp_replace(prose, '[^\p{{L}}]', '', 'g')) AS letters, CASE WHEN len(regexp_extract_all(prose, '\p{{Han}}')) >= 3 THEN 'zh' WHEN len(regexp_extract_all(prose, '\p{{Cyrillic}}')) >= 5 THEN 'ru' ELSE best END AS lang FROM c LEFT JOIN b USING (doc_id, line_no)),
        k AS (SELECT doc_id, lang, count(*) AS lines, sum(letters) AS letters FROM g WHERE lang IS NOT NULL GROUP BY ALL),
        d AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY doc_id) AS languages FROM k JOIN o USING (lang) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lines DESC, letters DESC, nth) = 1),
        n AS (SELECT doc_id, lower(trim(coalesce(lang, ''))) AS label FROM documents),
        a AS (SELECT n.doc_id, coalesce(x.code, y.code) AS code FROM n LEFT JOIN m x ON x.name = label LEFT JOIN m y ON y.name = regexp_split_to_array(label, '[-_ (,;/.]')[1])
        SELECT d.doc_id, 0 AS line_no, d.lang FROM d JOIN a USING (doc_id) WHERE code IS NULL OR code <> d.lang
        UNION SELECT g.doc_id, g.line_no, g.lang FROM g JOIN d USING (doc_id) WHERE languages > 1 AND g.lang IS NOT NULL"""
