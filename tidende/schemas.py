"""Explicit schemas of the inputs; nothing is inferred on the hot path."""

ARTICLE = "doc_id string, text string, pub_date date, ext_id string"
WIKI_PAGE = "title string, text string"
MENTION = "doc_id string, pos int, mention string"
DISAMBIGUATION = "doc_id string, pos int, mention string, kb string, entity string"
GOLD = "doc_id string, line_no int, pos int, mention string, entity string"
CATEGORY_LINK = "cl_to string, cl_sortkey string"
WORDS = "id bigint, form string"
WORD_SENSES = "word_id bigint, synset_id bigint"
RELATIONS = "synsets_id bigint, name2 string, value bigint"
SYNSETS = "id bigint, label string"
TERM_FREQUENCY = "term string, freq bigint"
EDGE = "src int, dst int"
NODE_LABEL = "id int, label string"
SEARCH_RESULT = "mention string, rank int, url string"
CONLL06 = ["index", "form", "lemma", "cpos", "pos", "feats", "head", "label", "phead", "plabel"]
CONLL09 = ["id", "form", "lemma", "plemma", "pos", "ppos", "feat", "pfeat", "head", "phead", "deprel", "pdeprel", "fillpred", "pred"]
