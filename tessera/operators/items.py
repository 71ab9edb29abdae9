"""Rules for quiz items: each one is a code, a layer, a message and a predicate over the columns of an item.

An item is (question, answer, options, clues, format, age_band, difficulty, category_n, is_mc). `with_issues` works out
what several rules need once (`context`), and then every rule is a Column, so that a table of items is judged in one pass
without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import places
from tessera.functions.keys import without_true_false
from tessera.functions.numbers import clamp
from tessera.functions.text import normalize, squeeze, strip_accents, strip_tags
from tessera.operators import reported

# --- fixed values: limits by age band --------------------------------------------------------------------------------

DIFFICULTIES = {"6-9": (1, 3), "10-15": (1, 4), "15+": (1, 5)}
#: Limits that hold in one band only are None in the others.
LIMITS = {
    "question_chars": {"6-9": 110, "10-15": 180, "15+": 240},
    "question_words": {"6-9": 18, "10-15": 22, "15+": None},
    "topic_question_words": {"6-9": 16, "10-15": None, "15+": None},
    "answer_words": {"6-9": 4, "10-15": None, "15+": None},
    "gap_answer_words": {"6-9": 2, "10-15": None, "15+": None},
    "topic_answer_words": {"6-9": None, "10-15": 6, "15+": None},
    "option_words": {"6-9": 4, "10-15": 6, "15+": 8},
    "option_chars": {"6-9": 38, "10-15": 52, "15+": 72},
    "word_chars": {"6-9": 13, "10-15": None, "15+": None},
    "cause_chars": {"6-9": 120, "10-15": 180, "15+": 200},
    "gap_total": {"6-9": 105, "10-15": 125, "15+": 145},
    "gap_before": {"6-9": 12, "10-15": 14, "15+": 16},
}
TECHNICAL_ANSWER_WORDS = 8
CURIOSITY_CHARS, WHAT_CHARS = 200, 95
OPTIONS_TOO_LONG = {
    "6-9": "opções demasiado longas para 6–9 (máx. 4 palavras)",
    "10-15": "opções demasiado longas para 10–15 (máx. 6 palavras) — sê mais directo",
    "15+": "opções demasiado longas — usa termos mais curtos",
}
#: By level: the least and greatest distance of years, the edits by which a name may be confused, whether near ones are asked for.
DISTRACTORS = {1: (5, 9999, 1, False), 2: (3, 80, 1, False), 3: (2, 45, 0, False), 4: (1, 25, 0, True), 5: (1, 15, 0, True)}
NEAR_LENGTH, NEAR_EDITS, NEAR_LEAST = 0.9, 1, 4
LEAKED_SHARE, LEAKED_WORD = 0.7, 4

# --- fixed values: patterns, all without regard to case ----------------------------------------------------------------

OPTION_KINDS = (
    ("year", r"^(cerca de\s+)?\d{3,4}s?$"),
    ("country", r"^(portugal|espanha|frança|franca|alemanha|japão|japao|itália|italia|brasil|china|índia|india|catar|inglaterra|eua|estados unidos)$"),
    ("brand", r"^(spacex|nasa|esa|agência espacial europeia|google|apple|meta|tesla|brt|de havilland|boeing|airbus|lockheed|ferrari|fiat|renault|peugeot|volkswagen|mercedes|bmw|toyota|honda|samsung|microsoft|netflix|amazon|ford)$"),
    ("substance", r"\b(biocombust[íi]vel|gasolina|petr[oó]leo|diesel|etanol|querosene|hidrog[eé]nio|propolente)\b"),
    ("proverb", None),
    ("film", None),
    ("literary_movement", r"\b(arcadismo|barroco|romantismo|modernismo|pós-modernismo|simbolismo|surrealismo|realismo|impressionismo|expressionismo)\b"),
    ("person", None),
    ("quantity", r"^\d|\b(milhões|mil milhões|cerca de)\b"),
    ("material", r"\b(nylon|algodão|algodao|lã|la|seda|poliéster|poliester|linho|couro|borracha|plástico|plastico|lycra|elastano|acrílico|acrilico)\b"),
    ("fashion_concept", r"\b(moda ética|moda genderless|vogue|fast fashion)\b"),
    ("concept", r"\b(tratado|missão|canal|narrador|viés|sistema|efeito|fenómeno|fenomeno|rotação|unidade|elipse)\b"),
)
PROVERB, PROVERB_WORDS = r"\b(é melhor|quem espera|devagar se vai|água mole)\b", 12
FILM_TITLE = r"^(o|a|os|as)\s+[«\"']?[A-ZÀÁÂÃÉÊÍÓÔÕÚÇ]"
FILM_WORDS = r"\b(matrix|origem|chihiro|trevas|driver|titanic|avatar|inception|vingadores|pantera|tarzan)\b"
NAME_PART, NAME_PARTICLE = r"^[A-ZÀÁÂÃÉÊÍÓÔÕÚÇ][a-zàáâãçéêíóôõú'-]+$", r"(?iu)^(de|da|do|dos|das|van|von)$"
BUCKETS = (
    ("color", r"^(azul|verde|vermelho|amarelo|preto|branco|rosa|roxo|laranja|castanho|cinzento|dourado|prateado)$"),
    ("sport", r"^(futebol|basquetebol|natação|natacao|ténis|tenis|andebol|hóquei|hoquei|voleibol|atletismo)$"),
    ("food", r"^(banana|maçã|maca|laranja|pão|pao|arroz|sopa|bolo)$"),
    ("place", r"^(lisboa|porto|paris|madrid|roma|berlim|londres|nova iorque|tóquio|toquio|évora|evora|coimbra|faro|braga|aveiro|guimarães|guimaraes|setúbal|setubal)$"),
    ("number", r"^\d+$"),
    ("geo_science", r"\b(cidade|país|pais|capital|continente|rio|montanha|planeta|oceano)\b"),
    ("nature", r"\b(animal|planta|árvore|arvore|mamífero|mamifero|pássaro|passaro|peixe)\b"),
)
FOREIGN_KINDS = ("film", "year", "country", "brand", "substance", "proverb", "literary_movement", "fashion_concept")
ABSURD_BUCKETS = ("color", "sport", "food", "place", "number")
NAMELESS_BUCKETS = ("entity", "geo_science", "nature")
ABSURD_OPTION = r"^(banana|futebol|azul|verde|vermelho|nada|qualquer|abc|xyz|123|nenhum|desconhecido)$"
ASKS_PERSON = r"\bquem\s+(é|e|foi|era)\s+(o|a|os|as)\b|\bquem\s+(interpretou|realizou|dirigiu|escreveu|inventou|compôs|compos|pintou|projectou|projetou|concebeu|construiu|ajudou)\b|\bqual\s+(ator|actriz|atriz|realizador|cineasta|engenheiro|arquitecto|arquiteto|inventor|compositor|pintor|escultor)\b"
NOT_WHEN = r"\bem\s+que\s+pa[ií]s\b|\bonde\s+fica\b|\bquem\s+(é|e|foi|inventou|escreveu|pintou|comp[oô]s)\b|\bqual\s+destes\s+(pa[ií]s|paises|países)\b|\bo\s+que\s+é\b"
WHEN = r"\b(quando\b|em\s+que\s+(ano|anos|m[eê]s|mes|dia|data|[eé]poca|epoca|per[ií]odo|periodo|s[eé]culo|seculo|d[eé]cada|decada)|que\s+(ano|m[eê]s|mes|d[eé]cada|decada|s[eé]culo|seculo)\b|a\s+que\s+(ano|[eé]poca|epoca)|em\s+qual\s+(ano|m[eê]s|mes|s[eé]culo|seculo))\b"
WHEN_ANSWER = r"^\d{3,4}$|^(s[eé]culo|seculo)\s+|^(janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)$|^\d{1,2}\s+de\s+\w+"
YEAR_OR_DATE = r"^(cerca de\s+)?\d{3,4}s?$|^\d{1,2}\s+de\s+[a-zà-ú]+\s+de\s+\d{3,4}$|^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$|^(século|seculo)\s+|^(ano(s)?\s+)?\d{3,4}$|^(em|no|de)\s+\d{3,4}\b|^ano(s)?\s+(de\s+)?\d{3,4}\b|^c\.?\s*\d{3,4}\b|^\d{3,4}\s*(d\.?c\.?|a\.?c\.?)\b|^(a\.?c\.?|d\.?c\.?)\s*\d{3,4}\b|^(anos?|década|decada)\s+(de\s+)?\d{1,2}\b"
HARD_WHEN = (r"\b(nasceu|nascimento|subiram|escalada|primeira\s+vez)\b", r"\b(picasso|einstein|shakespeare|beethoven|mozart|darwin|galileu|newton|everest|monte\s+everest)\b")
ICE, WHICH_SPORT = r"\bgelo\b|\bpatins\b.*\bdisco\b|\bdisco\b.*\bpatins\b", r"\b(que|qual)\s+desporto\b"
WATER, FIELD = r"\bágua\b|\bagua\b|\bpiscina\b|\bmar\b|\bnatação\b|\bnatacao\b", (r"\brelva\b|\bcampo\b|\bgrama\b", r"\bdesporto\b")
ICE_SPORT = r"\bhóquei\b|\bhoquei\b|\bpatinag|\bcurling\b|\bbobsleigh\b|\bluge\b|\bpatins\b"
OTHER_SPORT = r"\bténis\b|\btenis\b|\bfutebol\b|\bbasquetebol\b|\bsalto\b|\bmaratona\b|\bciclismo\b|\bgolfe\b|\bvoleibol\b|\bandebol\b|\batletismo\b"
DIVISION = r"(?iu)\b(\d+)\s+dividido\s+por\s+(\d+)\b"
ASKS_ANIMAL = r"\b(que animal|qual animal|que bicho|qual bicho|que mamífero|qual mamífero|que mamifero|qual mamifero)\b"
NOT_ANIMAL = r"\bilusão\b|\bóptica\b|\boptica\b|\bmüller|\bmueller\b|\b\d+\s*a\s*\d+\b|\bpercentagem\b|\bminut|\bsegund|\bvezes\b"
OPTICAL, FREQUENCY = r"\bilusão\b|\bóptica\b|\boptica\b", r"\b\d+\s*(a|–|-)\s*\d+\b|\bcerca de\s+\d+"
ANIMAL = r"\b(golfinho|salamandra|tigre|leão|leao|gato|cão|cao|pássaro|passaro|baleia|foca|pato)\b"
NOT_NEURONS = r"\bilus[aã]o|óptica|optica|müller|mueller|esfinge|d[eé]j[aà]\s*vu|enigma|filosof"
MOVEMENTS = r"\b(rota[çc][ãa]o|órbita|transla[çc][ãa]o|revolu[çc][ãa]o|movimento|eixo|dia|ano|lentid)\b"
MAP_AND_GLOBE = (r"\bcidades\b", r"\bn[aã]o\s+casas\b", r"\bmontanhas\b", r"\bn[aã]o\s+(árvores|arvores)\b", r"\b(água|agua)\b", r"\bn[aã]o\s+peixes\b")
LIKE_A_MAP = (r"\b(tenho|tem)\b", r"\b(cidades|montanhas)\b", r"\bn[aã]o\s+(casas|árvores|arvores|peixes)\b")
KITE, NO_KITE = r"\b(voar|vento|asas?|cauda|solt|brincar|papagaio)\b", r"\b(uva|vinho|barril|durmo|escuras|nasço da uva)\b"
ALIASES = (("winnie", "pooh"), ("ursinho", "pooh"), ("mickey", "rato mickey"))
BAD_RIDDLE_OPTION = r"\d|%|cerca de|aproximadamente|vértebra|vertebra|percentagem|milhões|milhoes|bilhões|bilhoes|graus celsius"
ADULT_TOPIC = r"\b(tratado|imperialismo|dodecafonismo|mitocôndria|algoritmo|quântico|burocracia|constituição|epistemologia|hegel|nietzsche|versalhes|holocausto|genocídio)\b"
COMPLEX_WORDS = r"\b(apesar de|embora|contudo|por conseguinte|outrossim|consequentemente)\b"
GRADUATE_TOPIC = r"\b(epistemologia|fenomenologia|dialética materialista|dodecafonismo|hegeliano|nietzscheano)\b"
ABSTRACT_MATH = r"(\d+\s*%|\bpercentagem\b|\bprobabilidade\b|\bfraç[ãõ]o\b|\bmédia\b)"
TECHNICAL = r"\b(mitocôndria|fotossíntese|condensação|eletromagnético|metamorfose celular)\b"
TOO_HARD = r"\b(imperialismo|algoritmo|programador|programadora|engenheir|máquina analítica|maquina analitica|babbage|tratado de versalhes|segunda guerra mundial|primeira guerra mundial)\b"
OBSCURE_PEOPLE = r"\b(cristofori|bartolomeo|johann|sebastian|wolfgang|amadeus|ludwig|beethoven|bach|mozart|chopin|verdi|puccini|galileu|copérnico|copernico|arquimedes|pitágoras|pitagoras|darwin|pasteur|faraday)\b"
CONSOLE = r"\b(playstation|ps\s*one|ps1|xbox|mega\s*drive|super\s*nintendo|nintendo\s*64)\b"
GAP = r"_{2,}|…|\.{3}"
NOT_A_PERSON = r"^(verdadeiro|falso|água|agua|fogo|terra|ar|sol|lua|lisboa|portugal|espanha|frança|franca|democracia|capitalismo|fotossíntese|fotossintese)$|^\d+$|\b(processo|fenómeno|fenomeno|teoria|sistema|planeta|país|pais|cidade|rio|montanha|oceano)\b"
FORMAT_LABEL = r"(?iu)^(curiosidade|adivinha|completa|quem é|o que é):\s*"
SURPRISE = r"\b(sabias que|sabias|é verdade que|curiosamente|surpreendentemente|incrível|poucas pessoas sabem)\b|verdadeiro\s+ou\s+falso"
PLACE_FEATURE = r"\b(rio|rios|montanha|montanhas|cordilheira|deserto|selva|floresta|planície|planicie|vale|arquipélago|arquipelago)\b"
VAGUE_WHERE = r"\bonde\s+(fica|está|esta|se\s+encontra)\b"
EXACT_WHERE = r"\b(em\s+que\s+(país|pais|cidade|continente|região|regiao|estado|província|provincia)|qual\s+é\s+a\s+capital|capital\s+de|nasce|nascer|desagua|desaguar|desemboca|localiza-se|situad[oa])\b"
COUNTRY_OPTION = r"\b(portugal|espanha|frança|franca|itália|italia|alemanha|brasil|angola|moçambique|mozambique|china|japão|japao|índia|india|europa|áfrica|africa|ásia|asia|américa|america)\b"
MOTION = r"\b(avião|aviao|comboio|autocarro|carro|elevador|barco)\b.*\b(a voar|voar|and|corre|move)\b|\b(largas?|deixas?\s+cair|soltas?)\b.*\b(moeda|bola|objecto|objeto)\b"
WHITHER, FRAME = r"\bpara onde\b.*\b(cai|cair|vai|ir)\b", r"\bem relação\b|\brelativamente\b|\bcontigo\b|\ba bordo\b|\bdentro do\b|\bvisto de dentro\b|\bpara ti\b"
WOMAN_ASKED, MAN_NAMED = r"\b(a|uma)\s+(engenheira|actriz|atriz|inventora|escritora|diretora|realizadora)\b", r"\b(dario|martin|james|john|robert|leonardo|quentin|stanley|heath|elon|ray|hiroshi)\b"
STEREOTYPE = r"\b(os|as)\s+(portugueses|portuguesas|japoneses|japonesas|chineses|chinesas|franceses|francesas|alemães|alemãs|alemoes|alemas|italianos|italianas|brasileiros|brasileiras|ingleses|britânicos|britânicas|árabes|africanos|africanas|americanos|americanas|homens|mulheres|crianças|miúdos|miúdas|rapazes|raparigas)\s+são\b|\btodos\s+os\s+(portugueses|japoneses|franceses|alemães|homens|mulheres|crianças|miúdos)\s+(gostam|são|fazem)\b"
SEVERAL = r"\b(pode ser|podem ser|várias respostas|duas respostas|tanto .+ como)\b"
TRANSPORT = r"\b(carro|carros|automóvel|automóveis|automovel|automoveis|avião|aviões|aviao|avioes|comboio|comboios|autocarro|autocarros|barco|navio|navios|mota|motas|bicicleta|bicicletas|elétrico|eléctrico|táxi|taxi|veículo|veículos|veiculo|veiculos|camião|camiões|caminhão|caminhões|camioneta|metropolitano|transporte público|transportes públicos)\b"
SPACE = r"\b(foguetão|foguete|foguetes|missão espacial|missão à lua|missao espacial|missao a lua|lançamento espacial|lançamento de foguete|nave espacial|astronauta)\b"
MOON = r"\b(homem|pessoa|astronauta).{0,40}\blua\b|\bprimeira\s+vez.{0,30}\blua\b|\bprimeiro\s+homem\b.*\blua\b"
MATTER = r"\b(solidifica[çc][ãa]o|congelamento|fundir|derreter|evapora[çc][ãa]o|estados?\s+(f[íi]sicos?|da\s+mat[ée]ria)|l[íi]quido\s+ao\s+s[óo]lido)\b"
TRIVIAL = r"\b(planeta onde vivemos|cor do céu|quantos dedos|quantas pernas tem um cão)\b"
#: Estimates of difficulty by topic: pattern, level (for the youngest, for the others), confidence.
TOPIC_LEVELS = (
    (r"\b(teorema|algoritmo|revolução industrial|segunda guerra mundial|primeira guerra mundial|tratado de versalhes|mitocôndria|fotossíntese|imperialismo)\b", 4, 4, 0.82),
    (r"\b(picasso|playstation|mega\s*drive|nintendo\s*64|everest|merckx|babbage|máquina analítica|maquina analitica)\b", 4, 3, 0.8),
    (r"\b(entropia|quantum|quântico|quantic|algoritmo genético|neurociência avançada)\b", 5, 5, 0.78),
    (r"\b(festividade|tradição|tradicional|obon|diwali|hanami|carnaval|solstício|antepassados|ritual|lanternas|costume|folclore)\b", 3, 4, 0.74),
)
BASIC = r"\b(cores primárias|quantas patas|água ferve|lua orbita|quantos continentes)\b"
CJK = r"一-鿿㐀-䶿豈-﫿぀-ヿㇰ-ㇿ가-힯"
FOREIGN_SCRIPT = rf"[{CJK}Ѐ-ӿ؀-ۿ]"
MIXED_WORD = r"\b[A-Za-zÀ-ÖØ-öø-ÿ]*[一-鿿぀-ヿ][A-Za-zÀ-ÖØ-öø-ÿ一-鿿぀-ヿ]*"
ENGLISH = (
    *("the", "and", "or", "a", "an", "is", "are", "was", "were", "of", "to", "in", "for", "on", "with", "at", "by", "from", "as", "that", "this", "it", "be", "have", "has", "had", "do", "does", "did"),
    *("will", "would", "could", "should", "may", "might", "not", "but", "if", "then", "than", "when", "where", "what", "which", "who", "how", "why", "all", "each", "every", "both", "some", "such"),
    *("no", "only", "same", "so", "too", "very", "can", "just", "because", "about", "into", "through", "during", "before", "after", "between", "under", "again", "once"),
)
ENGLISH_WORDS = r"\b(summer|winter|spring|autumn|fall|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|june|july|august|september|october|november|december|water|fire|earth|air|sun|moon|star|dog|cat|house|car|tree|flower|bird|fish|book|school|teacher|student|happy|sad|big|small|red|blue|green|yellow|black|white|because|always|never|sometimes|maybe|yes|no|hello|goodbye|friend|mother|father|brother|sister|boy|girl|man|woman|child|children|people|country|city|river|mountain|ocean|beach|food|drink|music|movie|game|play|run|walk|swim|fly|eat|sleep|read|write|learn|teach|think|know|want|need|like|love|hate|make|take|give|find|tell|ask|answer|question|true|false|right|wrong|hot|cold|warm|cool|new|old|young|long|short|high|low|fast|slow|easy|hard|good|bad|best|worst|first|last|next|many|much|few|little|lot|all|none|some|any|every|other|another|same|different)\b"
PORTUGUESE_WORDS = r"\b(não|sim|uma|uns|umas|que|com|por|para|dos|das|num|numa|são|é|está|estão|foi|foram|pelo|pela|este|esta|esse|essa|muito|mais|menos|também|ainda|já|sempre|nunca|onde|quando|como|qual|quais|quem|porque|então|mas|ou|nem|sem|sobre|entre|desde|até|há|anos|ano|dias|dia|país|pais|cidade|festa|escola|livro|água|agua|sol|lua|mar|rio|montanha|floresta|animal|planta|cor|verde|azul|vermelho|amarelo|branco|preto|grande|pequeno|bom|mau|novo|velho)\b"
PROPER_NOUN = (r"(?iu)^(The |DJ |Lady |Dr\.|MC )", r"^[A-Z][\w'.-]+(\s+[A-Z][\w'.-]+)+", r"^\d{4}$", r"(?iu)^(Beatles|Queen|ABBA|U2|Coldplay|Adele|Beyoncé|Beyonce|Madonna|Elvis|Nirvana|Metallica|Radiohead|Oasis|Blur)$")
BRAZILIAN = r"(?:ônibus|onibus|metrô|metrópole|você|vocês|celular|geladeira|banheiro|\btime\b(?!\s+de)|\blegal\b(?!\s+como))"
#: Turns of phrase that are not European Portuguese: pattern, a second one that has to hold as well, message.
VARIANTS = (
    (r"\bestilo\s+borboleta\b", None, 'vocabulário de natação brasileiro — em PT-PT usa "estilo mariposa"'),
    (r"\bvira\s+vapor\b", None, 'colquialismo brasileiro — em PT-PT diz "transforma-se em vapor" (não "vira vapor")'),
    (r"\btrem-baleiro\b", None, 'brasileirismo — em PT-PT usa "comboio maglev" ou "comboio de levitação magnética"'),
    (r"\btrem\b", r"\b(carris|propulsão|propulsao|magnétic|magnetic|levita|veículo|veiculo|transporte)\b", 'brasileirismo — em PT-PT usa "comboio" (não "trem")'),
    (r"\bcomboio\b", r"\btrilhos?\b", 'em PT-PT diz "carris" (não "trilhos") para o comboio'),
    (r"\bviés\b", None, 'brasileirismo — em PT-PT usa "enviesamento" ou "tendência de negatividade" (não "viés")'),
    (r"\bbolseiro\b", r"\b(frodo|senhor dos an[eé]is|um anel|tolkien)\b", 'nome de personagem — em PT-PT usa "Sacova" ou mantém "Baggins" (não a tradução brasileira Bolseiro)'),
    (r"\bavoando\b", None, 'erro ortográfico — escreve "a voar" (não "avoando")'),
    (r"\bcamisetas?\b", None, 'brasileirismo — em PT-PT usa "camisola" (não "camiseta")'),
    (r"\bchiclete\b", None, 'brasileirismo — em PT-PT usa "pastilha elástica" (não "chiclete")'),
    (r"\bbananadas\b", None, 'erro de vocabulário — em PT-PT usa "bananeiras" (planta), não "bananadas"'),
    (r"\b(marinheiro|marinha|listras\s+horizontais)\b", r"\br[eé]gatas?\b", 'em PT-PT diz "camisa às riscas" ou "camisa de marinheiro" (não "régatas")'),
    (r"\bmas\s+n[aã]o\s+voar\b", None, 'erro gramatical — escreve "não voa" (não "não voar")'),
)
FOOTBALL = r"\b(futebol|baliza|golos?|campo|árbitro|arbitro|penálti|penalti|fora de jogo|remate|guarda.?redes|equipa|campeonato|liga|marcador|defesa|avançado|ponta|médio|treinador|relva|canto|jogador)\b"
FOOTBALL_VARIANTS = (
    (r"\bgoleir[ao]s?\b", "guarda-redes"), (r"\bzagueir[ao]s?\b", "defesa"), (r"\b(atacante|centroavante|centro-avante)s?\b", "avançado ou ponta-de-lança"), (r"\bvolantes?\b", "médio"), (r"\bchutes?\b", "remate"),
    (r"\bchutar\b", "rematar"), (r"\bescanteios?\b", "canto"), (r"\bgramad[oa]s?\b", "relva"), (r"\btorcida\b", "adeptos"), (r"\bartilheiros?\b", "melhor marcador"), (r"\barremessos?\b", "pontapé"),
)
UNSURE = r"\b(não sei|nao sei|às vezes|as vezes|talvez|depende|não tenho a certeza)\b"
TWO_ANSWERS = ("verdadeiro", "falso")
#: The codes that say no more than that the difficulty is not the one asked for.
DIFFICULTY_CODES = ("DIFFICULTY_EASIER_THAN_REQUESTED", "DIFFICULTY_HARDER_THAN_REQUESTED", "DIFFICULTY_OUT_OF_RANGE")

# --- helpers -------------------------------------------------------------------------------------------------------------

ISSUE = "struct<code:string,layer:string,message:string>"
Test = Callable[["dict[str, Column] | Column"], Column]


@dataclass(frozen=True)
class Rule:
    code: str
    layer: str
    message: str | Test
    when: Test


def has(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(f"{reported.FLAGS}{pattern}"), F.lit(False))


def words(x: Column) -> Column:
    """How many runs without white space a text has."""
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def limit(age: Column, name: str) -> Column:
    """A band's limit, null where there is none; unknown bands have those of the oldest."""
    out = F.lit(LIMITS[name]["15+"]).cast("int")
    for band in ("6-9", "10-15"):
        out = F.when(age == band, F.lit(LIMITS[name][band]).cast("int")).otherwise(out)
    return out


def over(n: Column, most: Column) -> Column:
    return F.coalesce(n > most, F.lit(False))


def generic(answer: Column) -> Column:
    """Whether an answer is just true or false, whatever stands around it."""
    return F.regexp_replace(F.lower(answer), "[^a-záàâãéêíóôõúç]", "").isin(*TWO_ANSWERS)


def relaxed(x: Column) -> Column:
    """Traditional riddles for the younger bands, to which hardly any rule of age and difficulty applies."""
    return (x["format"] == "ADIVINHA") & x["age"].isin("6-9", "10-15")


def option_kind(o: Column) -> Column:
    """What an option looks like; the first kind of the table that fits."""
    n = words(o)
    film = (has(o, FILM_TITLE) & (n >= 2)) | has(o, FILM_WORDS)
    parts = F.size(F.filter(F.split(o, r"\s+"), lambda w: w.rlike(NAME_PART) | w.rlike(NAME_PARTICLE)))
    tests = {"proverb": (n > PROVERB_WORDS) | has(o, PROVERB), "film": film, "person": ~film & ~o.rlike(r"^\d") & n.between(1, 5) & (parts >= 1) & F.when(n == 1, F.length(o) <= 28).otherwise(parts >= 2)}
    out = F.lit("other")
    for kind, pattern in reversed(OPTION_KINDS):
        out = F.when(tests[kind] if pattern is None else has(o, pattern), kind).otherwise(out)
    return F.when(o == "", "empty").otherwise(out)


def concept_bucket(o: Column) -> Column:
    out = F.lit("entity")
    for bucket, pattern in reversed(BUCKETS):
        out = F.when(has(o, pattern), bucket).otherwise(out)
    return F.when(o == "", "empty").otherwise(out)


def option_key(o: Column) -> Column:
    """An option without case, marks and punctuation; runs of three or more of a character shrink to two."""
    plain = F.regexp_replace(strip_accents(F.lower(F.trim(o))), r"[^a-z0-9\s]", " ")
    return squeeze(F.regexp_replace(plain, r"(.)\1{2,}", "$1$1"))


def years(o: Column, decades: bool = True) -> Column:
    """Numbers of three or four digits from 100 to 2999, and what years a decade stands for."""
    found = F.filter(F.transform(F.regexp_extract_all(o, F.lit(r"\b(\d{3,4})\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(100, 2999))
    if not decades:
        return found
    # cast only what was found: a cast that fails costs an exception for each option
    decade = F.nullif(F.regexp_extract(o, rf"{reported.FLAGS}\b(?:anos?|década|decada)\s+(?:de\s+)?(\d{{1,2}})\b", 1), F.lit("")).cast("int")
    return F.when(decade.isNotNull(), F.concat(found, F.array(1900 + decade))).otherwise(found)


def year_like(o: Column) -> Column:
    return (o != "") & (has(o, YEAR_OR_DATE) | (F.size(years(o)) > 0))


def marks(options: Column) -> Column:
    """What near duplicates are told by, for each option once."""
    return F.transform(options, lambda o, i: F.struct(i.alias("i"), option_key(o).alias("key"), years(o).alias("years"), year_like(o).alias("dated")))


def near_equal(s: Column) -> Column:
    """Whether two options, given by their marks, are the same or nearly so; different years are not, however close they
    are written."""

    def close(a: Column, b: Column) -> Column:
        short, long_ = F.least(F.length(a["key"]), F.length(b["key"])), F.greatest(F.length(a["key"]), F.length(b["key"]))
        told_apart = (a["dated"] & b["dated"]) | ((F.size(a["years"]) > 0) & (F.size(b["years"]) > 0) & (a["years"] != b["years"]))
        return ~told_apart & (short >= NEAR_LEAST) & (short >= NEAR_LENGTH * long_) & (F.levenshtein(a["key"], b["key"], NEAR_EDITS) >= 0)

    def same(a: Column, b: Column) -> Column:
        return (a["key"] == b["key"]) | (a["key"] == "") | (b["key"] == "")

    return F.exists(s, lambda a: F.exists(s, lambda b: (a["i"] < b["i"]) & (same(a, b) | close(a, b))))


def asks_when(q: Column, a: Column) -> Column:
    return ~has(q, NOT_WHEN) & (has(q, WHEN) | has(F.trim(a), WHEN_ANSWER))


def leaked(q: Column, a: Column) -> Column:
    """Whether the question holds its answer, or most of its longer words if there are several."""
    question, answer = F.lower(F.trim(without_true_false(q))), F.lower(F.trim(a))
    plain = F.regexp_replace(strip_accents(answer), r"[^a-z0-9\s-]", " ")
    long_ = F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= LEAKED_WORD)
    held = F.size(F.filter(long_, lambda w: F.contains(question, w)))
    most = (F.size(long_) >= 2) & (held >= F.ceil(F.size(long_) * LEAKED_SHARE))
    return (F.length(answer) >= 3) & ~generic(a) & (question != "") & (F.contains(question, answer) | most)


def mostly_english(t: Column) -> Column:
    """Whether a text reads as English: a common English word, or half of two words or more are function words; never
    with Portuguese words or letters, or if it looks like a name."""
    named = reduce(or_, [t.rlike(p) for p in PROPER_NOUN])
    each = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    functional = F.size(F.filter(each, lambda w: F.regexp_replace(w, "[^a-z]", "").isin(*ENGLISH)))
    told = has(t, ENGLISH_WORDS) | ((F.size(each) >= 2) & (functional >= F.ceil(F.size(each) * 0.5)))
    return (t != "") & ~named & ~has(t, PORTUGUESE_WORDS) & ~has(t, "[ãõâêôáéíóúç]") & told


def english_part(parts: Column) -> Column:
    return F.exists(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~generic(p) & mostly_english(p))


def estimate_difficulty(q: Column, a: Column, age: Column) -> Column:
    """(level, confidence) that the topic and the length of an item suggest, within the range of the age band."""
    both, young, n = F.lower(F.concat_ws(" ", q, a)), age == "6-9", words(q)
    trivial = has(both, TRIVIAL)
    level, sure = [F.when(trivial, 1).otherwise(2)], [F.lit(0.45), F.when(trivial, 0.88), F.when(has(both, BASIC), 0.72)]
    for pattern, youngest, others, confidence in TOPIC_LEVELS:
        level.append(F.when(has(both, pattern), F.when(young, youngest).otherwise(others)))
        sure.append(F.when(has(both, pattern), confidence))
    level += [F.when(n > 28, 3), F.when(n > 42, 4)]
    low, high = difficulty_range(age)
    fitted = F.greatest(low, F.least(high, F.greatest(*level)))
    return F.struct(fitted.cast("int").alias("level"), F.greatest(*sure, F.when((fitted == low) | (fitted == high), 0.55)).alias("confidence"))


def difficulty_range(age: Column) -> tuple[Column, Column]:
    pick = lambda k: F.when(age == "6-9", DIFFICULTIES["6-9"][k]).when(age == "10-15", DIFFICULTIES["10-15"][k]).otherwise(DIFFICULTIES["15+"][k])
    return pick(0), pick(1)


def asked_difficulty(difficulty: Column, age: Column) -> Column:
    """The difficulty that an item is to have; the least of its band where it is missing, 0 or no number."""
    number = F.trim(difficulty.cast("string")).try_cast("double")
    return F.coalesce(F.nullif(F.when(~F.isnan(number), number), F.lit(0.0)), difficulty_range(age)[0].cast("double"))


# --- context and rules ---------------------------------------------------------------------------------------------------


#: What the rules look at, each a column of its own: fields of one struct would be worked out anew for every rule.
CONTEXT = ("q", "a", "raw", "options", "wrong", "kinds", "wrong_kinds", "wrong_buckets", "kind", "bucket", "blob", "q_words", "a_words", "clues", "format", "age", "difficulty", "category", "is_mc", "estimate", "place", "asked", "marks", "spelling", "facts")
Context = dict[str, Column]


def _at(name: str) -> Column:
    return F.col(f"_x_{name}")


def context(items: DataFrame) -> DataFrame:
    """items with a column _x_... for each name of CONTEXT."""
    clean = lambda c: F.trim(strip_tags(F.coalesce(c, F.lit(""))))
    none = F.array().cast("array<string>")
    q, a, raw, options, age = (_at(n) for n in ("q", "a", "raw", "options", "age"))
    steps = [
        {"q": clean(F.col("question")), "a": clean(F.col("answer")), "raw": F.coalesce("options", none), "clues": F.transform(F.coalesce("clues", none), lambda c: clean(c)), "format": F.coalesce("format", F.lit("")), "age": F.coalesce("age_band", F.lit("15+")), "difficulty": F.col("difficulty"), "category": F.col("category_n"), "is_mc": F.coalesce("is_mc", F.lit(False))},
        {"options": F.filter(F.transform(raw, lambda o: clean(o)), lambda o: o != ""), "blob": F.concat_ws(" ", q, a, F.concat_ws(" ", raw)), "q_words": words(q), "a_words": words(a), "estimate": estimate_difficulty(q, a, age), "asked": asked_difficulty(F.col("difficulty"), age), "spelling": places.mismatch(q, a), **reported.fields(q, a, raw)},
        # kind and bucket of the answer and of each option are worked out in one pass, by one expression
        {"seen": F.transform(F.concat(F.array(a), options), lambda o: F.struct(o.alias("text"), option_kind(o).alias("kind"), concept_bucket(o).alias("bucket"))), "marks": marks(options), "place": places.first_variant(_at("blob"))},
        {"others": F.filter(F.slice(_at("seen"), 2, F.size(_at("seen"))), lambda o: F.lower(o["text"]) != F.lower(a)), "kinds": F.slice(_at("seen")["kind"], 2, F.size(_at("seen"))), "kind": F.get(_at("seen"), F.lit(0))["kind"], "bucket": F.get(_at("seen"), F.lit(0))["bucket"]},
        {"wrong": _at("others")["text"], "wrong_kinds": _at("others")["kind"], "wrong_buckets": _at("others")["bucket"]},
    ]
    for step in steps:
        items = items.withColumns({f"_x_{name}": column for name, column in step.items()})
    return items


def _any(array: Column, *values: str) -> Column:
    return F.exists(array, lambda k: k.isin(*values))


def _count(array: Column, test: Test) -> Column:
    return F.size(F.filter(array, test))


def _all(x: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, p: a & has(x, p), patterns, F.lit(True))


def _four(test: Test) -> Test:
    """A rule of items with four options or more."""
    return lambda x: (F.size(x["options"]) >= 4) & test(x)


def option_rules() -> list[Rule]:
    layer, wrong_class = "mcOptions", "MC_WRONG_CLASS"
    person = lambda x: (x["format"] != "ADIVINHA") & ((x["format"] == "QUEM_E") | has(x["q"], ASKS_PERSON))
    when = lambda x: (x["format"] == "QUANDO") | asks_when(x["q"], x["a"])
    where = lambda x: (x["format"] == "ONDE_FICA") | has(x["q"], r"\b(em que país|em que continente|capital de|onde fica)\b")
    elsewhere = lambda x: ~where(x) & ~when(x)
    absurd = lambda x: (_count(x["wrong_buckets"], lambda b: b.isin(*ABSURD_BUCKETS)) >= 2) & ~x["bucket"].isin(*ABSURD_BUCKETS)

    def odd_one(kind: str) -> Test:
        return lambda x: F.array_contains(x["kinds"], kind) & (x["kind"] != kind)

    def division(x: Column, test: Callable[[Column, Column, Column], Column]) -> Column:
        dividend, divisor = (F.nullif(F.regexp_extract(x["q"], DIVISION, k), F.lit("")).try_cast("bigint") for k in (1, 2))
        even = (dividend != 0) & (divisor != 0) & (F.try_mod(dividend, divisor) == 0)
        return F.coalesce(even & test(dividend.cast("string"), divisor.cast("string"), F.try_divide(dividend, divisor).cast("bigint").cast("string")), F.lit(False))

    def acronym(x: Column) -> Column:
        n = F.size(x["wrong"])
        mean = lambda of: F.try_divide(F.aggregate(x["wrong"], F.lit(0), lambda s, o: s + of(o)), n)
        short = (x["a_words"] <= 2) & (F.length(x["a"]) <= 8) & F.regexp_replace(x["a"], r"\s", "").rlike("^[A-Za-zÀ-ú]{2,8}$")
        return short & (mean(words) >= 2) & (mean(F.length) > 2 * F.length(x["a"])) & F.forall(x["wrong"], lambda o: F.length(o) > F.length(x["a"]))

    def repeats_question(x: Column) -> Column:
        split = lambda t: F.filter(F.split(F.regexp_replace(strip_accents(F.lower(t)), r"[^a-z0-9\s-]", " "), r"\s+"), lambda w: F.length(w) > 2)
        asked = split(x["q"])
        return F.exists(F.transform(x["wrong"], split), lambda o: (F.size(o) >= 2) & F.forall(o, lambda w: F.array_contains(asked, w)))

    def themes(x: Column) -> Column:
        theme = lambda o: F.when(has(o, OPTICAL), "optical").when(has(o, FREQUENCY), "frequency").when(has(o, ANIMAL), "animal")
        return F.size(F.array_distinct(F.array_compact(F.transform(x["options"], theme)))) >= 3

    map_or_globe = lambda x: (x["format"] == "ADIVINHA") & F.exists(x["options"], lambda o: has(o, r"\bmapa\b")) & F.exists(x["options"], lambda o: has(o, r"\bglobo\b"))
    exactly_four = lambda test: lambda x: (F.size(x["raw"]) == 4) & test(x)
    named = lambda x, part: F.exists(x["raw"], lambda o: F.contains(F.lower(o), F.lit(part)))
    aliases = lambda x: reduce(or_, [named(x, p) & named(x, r) for p, r in ALIASES])
    return [
        Rule("MC_MULTIPLE_CORRECT", layer, "deve haver exactamente uma opção correcta", lambda x: _count(x["raw"], lambda o: normalize(o) == normalize(x["a"])) != 1),
        Rule(wrong_class, layer, "distratores de classes conceptuais diferentes (ex.: cores, cidades ou desportos misturados com o tema)", _four(absurd)),
        Rule(wrong_class, layer, "distratores incoerentes — devem pertencer à mesma classe conceptual que a resposta", _four(lambda x: ~absurd(x) & (x["bucket"] == "entity") & (F.size(F.array_distinct(F.filter(x["wrong_buckets"], lambda b: ~b.isin(*NAMELESS_BUCKETS)))) >= 3))),
        Rule(wrong_class, layer, "distratores incoerentes — mistura tipos incompatíveis (filmes, anos, países, marcas…)", _four(lambda x: ~absurd(x) & (_count(x["wrong_kinds"], lambda k: k.isin(*FOREIGN_KINDS)) >= 2) & ~x["kind"].isin(*FOREIGN_KINDS))),
        Rule(wrong_class, layer, "opções incoerentes — a pergunta pede uma pessoa; todas as opções devem ser nomes de pessoas (não empresas, combustíveis nem objectos)", _four(lambda x: person(x) & F.exists(x["wrong_kinds"], lambda k: k != "person"))),
        Rule(wrong_class, layer, "opções incoerentes — distractores devem ser tipos de narrador, não movimentos literários nem autores soltos", _four(lambda x: has(x["q"], r"\bnarrador\b") & _any(x["kinds"], "literary_movement", "film", "year", "country"))),
        Rule(wrong_class, layer, "opções incoerentes — distractores devem ser formas gramaticais (ré/ré), não movimentos literários nem outros temas", _four(lambda x: (has(x["q"], r"\b(feminino|masculino)\s+de\s+r[eé]u\b") | (has(x["q"], r"\br[eé]u\b") & has(x["q"], r"\bfeminino\b"))) & _any(x["kinds"], "literary_movement", "film", "year", "country", "brand"))),
        Rule(wrong_class, layer, "opções incoerentes — distractores devem ser quantidades ou conceitos de neurociência, não filosofia ou ilusões de ótica", _four(lambda x: has(x["q"], r"\bneur[oó]nio|c[eé]rebro humano\b") & F.exists(x["wrong"], lambda o: has(o, NOT_NEURONS)))),
        Rule(wrong_class, layer, "opções incoerentes — distractores devem ser missões ou programas espaciais", _four(lambda x: has(x["q"], r"\bmissão\b") & has(x["q"], r"\b(sonda|cometa|espacial|marte|lua)\b") & _any(x["kinds"], "country", "brand", "proverb", "literary_movement", "fashion_concept"))),
        Rule(wrong_class, layer, "opções incoerentes — distractores devem ser unidades ou conceitos astronómicos", _four(lambda x: (has(x["q"], r"\bunidade\s+astron[oó]mic") | (has(x["q"], r"\bunidade\b") & has(x["q"], r"\b(terra|sol|dist[aâ]ncia)\b"))) & _any(x["kinds"], "film", "person", "country", "brand", "proverb"))),
        Rule(wrong_class, layer, "opções incoerentes — distractores devem descrever movimentos ou rotações planetárias", _four(lambda x: has(x["q"], r"\brota[çc][ãa]o\b") & has(x["q"], r"\b(v[eé]nus|planeta)\b") & (_count(x["wrong"], lambda o: ~has(o, MOVEMENTS)) >= 2))),
        Rule(wrong_class, layer, "opções incoerentes — anos isolados não servem de distractores fora de perguntas QUANDO", _four(lambda x: ~when(x) & odd_one("year")(x))),
        Rule(wrong_class, layer, "opções incoerentes — países isolados não encaixam nesta pergunta", _four(lambda x: elsewhere(x) & odd_one("country")(x))),
        Rule(wrong_class, layer, "opções incoerentes — marcas ou empresas genéricas (ex.: SpaceX) não encaixam nesta pergunta", _four(lambda x: elsewhere(x) & odd_one("brand")(x) & ~has(x["q"], r"\b(empresa|marca|spacex|nasa|esa)\b"))),
        Rule(wrong_class, layer, "opções incoerentes — combustíveis ou substâncias não encaixam nesta pergunta", _four(lambda x: elsewhere(x) & odd_one("substance")(x))),
        Rule(wrong_class, layer, "opções incoerentes — não uses provérbios ou frases longas como opção de escolha múltipla", _four(lambda x: F.array_contains(x["kinds"], "proverb"))),
        Rule(wrong_class, layer, "opções parecem respostas de perguntas diferentes — todas devem ser do mesmo tipo", _four(lambda x: F.size(F.array_distinct(F.filter(x["kinds"], lambda k: k.isin(*FOREIGN_KINDS)))) >= 2)),
        Rule(wrong_class, layer, "distratores devem ser materiais ou tecidos, não conceitos de moda", _four(lambda x: has(x["q"], r"\b(material|tecido|fibr[ao]|sintétic|sintetic)\b") & F.array_contains(x["wrong_kinds"], "fashion_concept"))),
        Rule("MC_TOO_OBVIOUS", layer, "demasiado óbvio — a resposta correcta destoa dos distractores; torna os errados plausíveis e do mesmo estilo", _four(acronym)),
        Rule(wrong_class, layer, "distratores demasiado óbvios — com pergunta sobre gelo, as opções erradas devem ser outros desportos de gelo plausíveis", _four(lambda x: has(x["q"], WHICH_SPORT) & has(x["q"], ICE) & (_count(x["wrong"], lambda o: ~has(o, ICE_SPORT) & has(o, OTHER_SPORT)) >= 2))),
        Rule("MC_TRIVIAL_MATH", layer, "resposta matemática incorrecta ou demasiado óbvia — confirma o quociente da divisão", lambda x: division(x, lambda n, d, q: x["a"] == d)),
        Rule("MC_TRIVIAL_MATH", layer, "opções de divisão demasiado óbvias — os distractores não devem incluir dividendo e divisor", lambda x: division(x, lambda n, d, q: (x["a"] != d) & F.array_contains(x["wrong"], n) & F.array_contains(x["wrong"], d))),
        Rule("MC_TRIVIAL_MATH", layer, "opções de divisão demasiado óbvias — evita dividendo e divisor como distractores", lambda x: division(x, lambda n, d, q: (x["a"] != d) & (x["a"] == q) & F.forall(x["wrong"], lambda o: o.rlike(r"^\d+$")) & (F.array_contains(x["wrong"], n) | F.array_contains(x["wrong"], d)))),
        Rule("MC_NEAR_DUPLICATE", layer, "opções repetidas ou quase iguais (ex.: Woody / Wooody / Sheriff Woody)", lambda x: (F.size(x["options"]) >= 2) & near_equal(x["marks"])),
        Rule("MC_OPTIONS_TOO_LONG", layer, lambda x: F.when(x["age"] == "6-9", OPTIONS_TOO_LONG["6-9"]).when(x["age"] == "10-15", OPTIONS_TOO_LONG["10-15"]).otherwise(OPTIONS_TOO_LONG["15+"]), lambda x: (F.size(x["options"]) >= 2) & F.exists(x["options"], lambda o: (words(o) > limit(x["age"], "option_words")) | (F.length(o) > limit(x["age"], "option_chars")))),
        Rule(wrong_class, layer, "opções ambíguas — alcunha e nome do mesmo personagem", aliases),
        Rule(wrong_class, layer, 'nome ambíguo — em PT-PT usa "Ursinho Puff" de forma consistente', lambda x: has(x["a"], r"\b(pooh|winnie)\b") & (_count(x["raw"], lambda o: has(o, r"\b(pooh|winnie|ursinho)\b")) >= 2)),
        Rule("ADIVINHA_MAP_GLOBE_AMBIGUOUS", "semantic", "pergunta ambígua — mapa e globo terráqueo respondem às mesmas pistas; reformula ou usa distractores claramente errados", lambda x: map_or_globe(x) & _all(x["q"], MAP_AND_GLOBE)),
        Rule("ADIVINHA_MAP_GLOBE_AMBIGUOUS", "semantic", "pergunta ambígua — mapa e globo terráqueo são ambas defensáveis nesta adivinha", lambda x: map_or_globe(x) & _all(x["q"], LIKE_A_MAP) & ~_all(x["q"], MAP_AND_GLOBE)),
        Rule("ADIVINHA_MC_BAD_DISTRACTORS", layer, "distratores de adivinha inválidos — devem ser objectos ou palavras plausíveis, não números nem factos científicos", lambda x: (x["format"] == "ADIVINHA") & F.exists(x["wrong"], lambda o: (F.length(o) > 48) | has(o, BAD_RIDDLE_OPTION) | (words(o) > 6) | ((words(o) >= 4) & o.contains(",")))),
        Rule(wrong_class, layer, "opções incoerentes — misturam temas diferentes (ex.: animal com ilusão de ótica ou números)", exactly_four(_four(lambda x: has(x["q"], ASKS_ANIMAL) & F.exists(x["options"], lambda o: has(o, NOT_ANIMAL))))),
        Rule(wrong_class, layer, "opções parecem respostas de perguntas diferentes — todas devem ser do mesmo tipo", exactly_four(_four(themes))),
        Rule("MC_ABSURD_DISTRACTORS", layer, "distratores demasiado absurdos", exactly_four(lambda x: _count(x["wrong"], lambda o: has(o, ABSURD_OPTION)) >= 2)),
        Rule("MC_OPTION_LEAKS_QUESTION", layer, "opção errada contém pista da pergunta", exactly_four(repeats_question)),
        *distractor_rules(),
    ]


def distractor_rules() -> list[Rule]:
    """How near the wrong options are to the right one, against what the level asks for."""
    level = lambda x: clamp(F.coalesce(F.nullif(x["difficulty"], F.lit(0)), F.lit(3)), 1, 5).cast("int")

    def of(x: Column, k: int) -> Column:
        return F.element_at(F.array(*[F.lit(DISTRACTORS[n][k]) for n in range(1, 6)]), level(x))

    plain = lambda o: strip_accents(F.lower(o))
    wrong = lambda x: F.filter(x["options"], lambda o: plain(o) != plain(x["a"]))
    right = lambda x: F.try_element_at(years(x["a"], False), F.lit(1))
    gaps = lambda x: F.transform(wrong(x), lambda o: F.array_min(F.transform(years(o, False), lambda y: F.abs(y - right(x)))))
    asked = lambda x: ~x["format"].isin("VERDADEIRO_FALSO", "CURIOSIDADE") & (F.size(x["options"]) >= 4) & (F.size(wrong(x)) >= 3)
    dated = lambda x: asked(x) & right(x).isNotNull() & F.forall(gaps(x), lambda g: g.isNotNull())
    confused = lambda x, o: (F.length(o) >= 5) & (F.length(x["a"]) >= 5) & ~((F.size(years(o, False)) > 0) & right(x).isNotNull()) & (F.levenshtein(plain(o), plain(x["a"])) <= of(x, 2))
    said = lambda before, after: lambda x: F.concat(F.lit(before), level(x).cast("string"), F.lit(after))
    layer = "mcOptions"
    return [
        Rule("MC_DISTRACTORS_TOO_FAR", layer, said("distractores demasiado óbvios para dificuldade ", " — usa alternativas próximas da resposta"), lambda x: asked(x) & of(x, 3) & F.exists(wrong(x), lambda o: has(o, ABSURD_OPTION))),
        Rule("MC_DISTRACTORS_TOO_CLOSE", layer, said("anos demasiado próximos para dificuldade ", " — o jogador não consegue distinguir"), lambda x: dated(x) & (F.array_min(gaps(x)) < of(x, 0))),
        Rule("MC_DISTRACTORS_TOO_FAR", layer, said("anos demasiado afastados para dificuldade ", " — aproxima os distractores da data correcta"), lambda x: dated(x) & of(x, 3) & (F.array_min(gaps(x)) > of(x, 1))),
        Rule("MC_DISTRACTORS_TOO_CLOSE", layer, said("opções quase iguais à resposta — em dificuldade ", " os distractores devem ser fáceis de distinguir"), lambda x: asked(x) & (of(x, 2) > 0) & F.exists(wrong(x), lambda o: confused(x, o))),
    ]


def age_rules() -> list[Rule]:
    hard = lambda message, when: Rule("AGE_TOO_HARD", "age", message, lambda x: ~relaxed(x) & when(x))
    young = lambda when: lambda x: (x["age"] == "6-9") & when(x)
    middle = lambda when: lambda x: (x["age"] == "10-15") & when(x)
    gapped = lambda x: (x["format"] == "COMPLETA") | x["q"].rlike(GAP)
    who = lambda x: x["format"] == "QUEM_E"
    return [
        hard("pergunta demasiado longa", lambda x: over(F.length(x["q"]), limit(x["age"], "question_chars")) | over(x["q_words"], limit(x["age"], "question_words"))),
        hard("resposta COMPLETA demasiado longa para 6–9 (máx. 2 palavras)", lambda x: gapped(x) & over(x["a_words"], limit(x["age"], "gap_answer_words"))),
        hard("resposta demasiado longa", lambda x: ~gapped(x) & over(x["a_words"], limit(x["age"], "answer_words"))),
        Rule("AGE_TOO_HARD", "age", "data histórica demasiado difícil para 6–9", young(lambda x: (x["format"] == "QUANDO") & has(x["q"], HARD_WHEN[0]) & has(x["q"], HARD_WHEN[1]))),
        hard("conceito matemático abstrato", young(lambda x: has(x["blob"], ABSTRACT_MATH))),
        hard("vocabulário técnico", young(lambda x: has(x["blob"], TECHNICAL))),
        hard("tema avançado demais", young(lambda x: has(x["blob"], TOO_HARD))),
        hard("personagem ou tema demasiado avançado para 6–9", young(lambda x: has(x["blob"], OBSCURE_PEOPLE))),
        Rule("FORMAT_VIOLATION", "format", 'formulação incorrecta — evita "Quem é quem"', young(lambda x: ~relaxed(x) & has(x["q"], r"quem\s+(é|e)\s+quem\b"))),
        hard("inventor de instrumento demasiado avançado para 6–9", young(lambda x: who(x) & has(x["q"], r"\b(inventou|criou|descobriu)\s+o\s+(piano|violino|gramofone|telefone)\b"))),
        hard("data de obra pictórica demasiado avançada para 6–9", young(lambda x: has(x["blob"], r"\bvan\s+gogh\b") & has(x["q"], r"\bem\s+que\s+ano\b"))),
        hard("obra de arte histórica demasiado avançada para 6–9", young(lambda x: has(x["blob"], r"\bvan\s+gogh\b") & has(x["blob"], r"\bnoite\s+estrelada\b"))),
        hard('para 6–9 prefere personagem, não autor (ex.: "Quem é o menino de Harry Potter?")', young(lambda x: who(x) & has(x["q"], r"\b(escreveu|escreve|autor|autora)\b"))),
        hard('nome com iniciais difícil para 6–9 (ex.: evita "J.K. Rowling")', young(lambda x: who(x) & x["a"].rlike(r"^[A-Z]\.[A-Z]\.|\b[A-Z]\.[A-Z]\.\s"))),
        hard("nome de pessoa demasiado longo para 6–9 (máx. 2 palavras)", young(lambda x: who(x) & (x["a_words"] >= 3))),
        hard("data de lançamento de consola demasiado difícil para 6–9", young(lambda x: (x["format"] == "QUANDO") & has(x["blob"], CONSOLE))),
        hard("artista ou género musical demasiado avançado para 6–9", young(lambda x: has(x["blob"], r"\b(bob\s+marley|reggae)\b"))),
        Rule("FORMAT_VIOLATION", "format", "pergunta O que é demasiado longa para 6–9", young(lambda x: (x["format"] == "O_QUE_E") & (F.length(x["q"]) > WHAT_CHARS))),
        hard("tema inadequado para 6–9", young(lambda x: has(x["blob"], ADULT_TOPIC))),
        hard("linguagem demasiado complexa para 6–9", young(lambda x: has(x["q"], COMPLEX_WORDS))),
        hard("pergunta demasiado complexa para 6–9", young(lambda x: over(x["q_words"], limit(x["age"], "topic_question_words")) & ~has(x["q"], "completa"))),
        hard("palavras demasiado complexas", young(lambda x: F.exists(F.split(x["q"], r"\s+"), lambda w: F.length(F.regexp_replace(F.lower(w), "[^a-zàáâãäåèéêëìíîïòóôõöùúûüçñ-]", "")) > limit(x["age"], "word_chars")))),
        hard("resposta demasiado técnica", middle(lambda x: has(x["a"], TECHNICAL) & (x["a_words"] > TECHNICAL_ANSWER_WORDS))),
        hard("tema inadequado para 10–15", middle(lambda x: has(x["blob"], GRADUATE_TOPIC))),
        hard("pergunta demasiado complexa para 10–15", middle(lambda x: over(x["q_words"], limit(x["age"], "question_words")))),
        hard("resposta demasiado longa para 10–15", middle(lambda x: over(x["a_words"], limit(x["age"], "topic_answer_words")))),
        Rule("AGE_TOO_HARD", "age", "personagem secundário obscuro para 6–9 — usa personagens principais", young(lambda x: has(x["q"], r"\b(cinderela|cinderella)\b") & has(x["q"], r"\b(rato|ratos)\b") & has(x["a"], r"\b(jaquim|jaq|gus|névoa|nevoa)\b"))),
        Rule("AGE_TOO_HARD", "age", "missão à Lua demasiado avançada para 6–9", young(lambda x: x["category"].isNotNull() & has(x["q"], r"\b(homem|pessoa).{0,25}\blua\b|\bfoi\s+à\s+lua\b"))),
    ]


def difficulty_rules() -> list[Rule]:
    low, high = (lambda x: difficulty_range(x["age"])[0]), (lambda x: difficulty_range(x["age"])[1])
    asked = lambda x: F.greatest(low(x), F.least(high(x), F.floor(x["asked"] + 0.5))).cast("int")
    gap = lambda x: asked(x) - x["estimate"]["level"]
    need = lambda x: F.when(x["estimate"]["confidence"] >= 0.85, 1).otherwise(2)
    hard = lambda message, when: Rule("AGE_TOO_HARD", "age", message, lambda x: ~relaxed(x) & (x["age"] == "6-9") & when(x))
    told = lambda x, verdict: F.concat(F.lit("dificuldade pedida "), asked(x).cast("string"), F.lit(" mas estimada "), x["estimate"]["level"].cast("string"), F.lit(f" — pergunta demasiado {verdict} para o nível pedido"))
    written = lambda x: F.when(x["asked"] == F.floor(x["asked"]), x["asked"].cast("bigint").cast("string")).otherwise(x["asked"].cast("string"))
    return [
        Rule("DIFFICULTY_OUT_OF_RANGE", "difficulty", lambda x: F.concat(F.lit("dificuldade "), written(x), F.lit(" incompatível com faixa "), x["age"]), lambda x: ~relaxed(x) & ~x["asked"].between(low(x), high(x))),
        hard("demasiado difícil para 6–9", lambda x: (x["asked"] >= 4) | ((x["asked"] <= 2) & has(x["q"], r"\b(teorema|algoritmo|revolução industrial|segunda guerra)\b"))),
        Rule("AGE_TOO_EASY", "difficulty", "demasiado fácil para +15 nível exigente", lambda x: ~relaxed(x) & (x["age"] == "15+") & (x["asked"] >= 4) & has(x["q"], TRIVIAL)),
        Rule("DIFFICULTY_EASIER_THAN_REQUESTED", "difficulty", lambda x: told(x, "fácil"), lambda x: ~relaxed(x) & (gap(x) >= need(x))),
        Rule("DIFFICULTY_HARDER_THAN_REQUESTED", "difficulty", lambda x: told(x, "difícil"), lambda x: ~relaxed(x) & (-gap(x) >= need(x))),
    ]


def format_rules() -> list[Rule]:
    of = lambda *names: lambda x: x["format"].isin(*names)
    wrong = lambda names, message, when: Rule("FORMAT_VIOLATION", "format", message, lambda x: of(*names)(x) & when(x))
    riddle = lambda code, message, when: Rule(code, "format", message, lambda x: (x["format"] == "ADIVINHA") & when(x))
    grown = lambda code, message, when: riddle(code, message, lambda x: ~relaxed(x) & when(x))
    body = lambda x: F.regexp_replace(x["q"], FORMAT_LABEL, "")
    gap_at = lambda x: F.regexp_instr(x["q"], F.lit(f"({GAP})"))
    before = lambda x: F.trim(F.regexp_replace(F.substr(x["q"], F.lit(1), gap_at(x) - 1), r"(?iu)^completa:\s*", ""))
    after = lambda x: F.trim(F.regexp_replace(F.substr(x["q"], gap_at(x)), rf"^({GAP})", ""))
    gapped = lambda x: gap_at(x) > 0
    labels = lambda x: F.transform(x["raw"], lambda o: F.lower(strip_tags(o)))
    norms = lambda x: F.filter(F.transform(x["clues"], F.lower), lambda c: c != "")
    answer = lambda x: F.lower(x["a"])
    curiosity, two = ("CURIOSIDADE",), ("VERDADEIRO_FALSO", "CURIOSIDADE")
    vague = lambda x: has(x["q"], PLACE_FEATURE) & has(x["q"], VAGUE_WHERE) & ~has(x["q"], EXACT_WHERE)
    return [
        wrong(curiosity, 'CURIOSIDADE: inclui "Verdadeiro ou Falso?" no final da pergunta', lambda x: has(body(x), SURPRISE) & ~has(body(x), r"verdadeiro\s+ou\s+falso")),
        wrong(curiosity, "CURIOSIDADE não deve ser pergunta simples de ano/data", lambda x: has(body(x), r"^em que ano\b|^qual é o ano\b|^em que ano foram\b|^quando foram realizados\b") & ~has(body(x), SURPRISE)),
        wrong(curiosity, "CURIOSIDADE não deve ser pergunta geográfica banal", lambda x: has(body(x), r"^em que (país|cidade|continente)\b") & ~has(body(x), SURPRISE)),
        wrong(curiosity, "CURIOSIDADE demasiado longa para ler em voz alta", lambda x: F.length(body(x)) > CURIOSITY_CHARS),
        wrong(curiosity, "CURIOSIDADE: resposta tem de ser Verdadeiro ou Falso", lambda x: ~answer(x).isin(*TWO_ANSWERS)),
        wrong(curiosity, "CURIOSIDADE: exactamente 2 opções — Verdadeiro e Falso", lambda x: F.size(x["raw"]) != 2),
        wrong(curiosity, "CURIOSIDADE: opções inválidas — só Verdadeiro e Falso", lambda x: F.exists(x["raw"], lambda o: has(o, UNSURE))),
        wrong(curiosity, "CURIOSIDADE: opções têm de ser Verdadeiro e Falso", lambda x: (F.size(x["raw"]) == 2) & ~(F.array_contains(labels(x), TWO_ANSWERS[0]) & F.array_contains(labels(x), TWO_ANSWERS[1]))),
        wrong(two[:1], "a resposta tem de ser verdadeiro ou falso", lambda x: ~generic(x["a"])),
        wrong(("QUEM_E",), 'QUEM_E deve começar por "Quem"', lambda x: ~has(x["q"], r"^quem\b|qual\s+(é|e)\s+o\s+nome\b")),
        wrong(("QUEM_E",), 'QUEM_E: evita "Quem é quem"', lambda x: has(x["q"], r"quem\s+(é|e)\s+quem\b")),
        wrong(("QUEM_E",), 'QUEM_E não deve usar "O que é"', lambda x: has(x["q"], r"^o\s+que\s+(é|e)\b")),
        wrong(("QUEM_E",), "QUEM_E: resposta deve ser uma pessoa", lambda x: (x["a"] == "") | has(answer(x), NOT_A_PERSON)),
        wrong(("QUEM_E",), "inconsistência de género — a pergunta pede uma mulher mas a resposta é um nome masculino", lambda x: has(x["q"], WOMAN_ASKED) & has(x["a"], MAN_NAMED)),
        wrong(("O_QUE_E",), "O_QUE_E deve perguntar por conceito/termo/fenómeno", lambda x: ~has(x["q"], r"^o\s+que\b|^que\s+significa\b|^qual\s+é\s+o\s+(termo|significado|nome do)\b")),
        wrong(("O_QUE_E",), "O_QUE_E não deve perguntar por pessoa", lambda x: has(x["q"], r"^quem\b")),
        wrong(("COMPLETA",), "COMPLETA deve ter lacuna visível", lambda x: ~gapped(x) & ~has(x["q"], "completa|falta")),
        wrong(("COMPLETA",), "COMPLETA: a lacuna deve ficar no final da frase (sem texto depois)", lambda x: gapped(x) & (after(x) != "") & ~after(x).rlike(r"^[.?!…]+$")),
        wrong(("COMPLETA",), "COMPLETA: a lacuna tem de ser a última parte da frase", lambda x: gapped(x) & ~x["q"].rlike(rf"({GAP})\s*[.?!…]?\s*$")),
        wrong(("COMPLETA",), "COMPLETA demasiado longa para ler em voz alta", lambda x: gapped(x) & (F.length(x["q"]) > limit(x["age"], "gap_total"))),
        wrong(("COMPLETA",), "COMPLETA: demasiado texto antes da lacuna", lambda x: gapped(x) & (words(before(x)) > limit(x["age"], "gap_before"))),
        wrong(("ONDE_FICA",), "ONDE_FICA deve perguntar por localização", lambda x: ~has(x["q"], r"\bonde\b|\bem\s+que\s+(país|cidade|continente|região|regiao)\b")),
        wrong(("ONDE_FICA",), "ONDE_FICA ambíguo — especifica país de origem, desagua, capital ou continente", vague),
        wrong(("ONDE_FICA",), "ONDE_FICA com países/continentes exige localização inequívoca", lambda x: vague(x) & (F.size(x["options"]) >= 3) & (_count(x["options"], lambda o: has(o, COUNTRY_OPTION)) >= 2)),
        wrong(("QUANDO",), "QUANDO deve pedir tempo/data/período", lambda x: ~asks_when(x["q"], x["a"])),
        riddle("ADIVINHA_FACTUAL_DIRECT", "ADIVINHA não deve ser pergunta factual directa", lambda x: has(x["q"], r"^qual\s+é\s+a\s+capital\b|^quem\s+descobriu\b")),
        grown("ADIVINHA_NO_ANSWER", "ADIVINHA sem solução registada", lambda x: (x["a"] == "") | has(x["a"], r"^sem\s+resposta$")),
        grown("ADIVINHA_VERBOSE_ANSWER", "ADIVINHA: resposta demasiado longa — usa uma palavra ou expressão curta", lambda x: x["a_words"] > 5),
        grown("ADIVINHA_ANIMAL_PHRASING", 'ADIVINHA: usa "Que animal…" em vez de "Quem é o animal"', lambda x: has(x["q"], r"\bquem\s+é\s+o\s+(animal|bicho|pássaro|passaro|peixe|insecto|inseto)\b")),
        grown("ADIVINHA_PERCUSSION", 'ADIVINHA: objecto que "canta quando é batido" deve ser instrumento de percussão', lambda x: has(x["q"], r"\b(canta|som)\b.*\b(batid|bate)\b|\b(batid|bate).*\b(canta|som)\b") & ~has(x["a"], r"\b(tambor|caixa|pandeiro|instrumento|musical)\b")),
        grown("ADIVINHA_WEAK_RIDDLE", "ADIVINHA: adivinha fraca — a resposta não encaixa bem nas pistas", lambda x: has(x["q"], r"\bpernas\b.*\bnão\s+anda\b") & has(x["a"], r"\b(bola|cadeira|mesa)\b")),
        grown("ADIVINHA_WHISTLE_RIDDLE", "ADIVINHA: adivinha clássica do apito — a resposta não deve ser um animal", lambda x: has(x["q"], r"\b(faz|fazem)\s+barulho\b") & has(x["q"], r"\bcorre\b") & has(x["q"], r"\b(cala|calou)\b") & has(x["a"], r"\b(cavalo|cabra|vaca|ovelha|carneiro|porco|rato)\b") & ~has(x["a"], r"\b(apito|pião|piao|flauta|corneta|reco-reco)\b")),
        riddle("ADIVINHA_MISSING_CLUES", 'ADIVINHA deve incluir array "clues" com pelo menos 2 pistas curtas', lambda x: F.size(x["clues"]) < 2),
        Rule("FORMAT_VIOLATION", "format", "ADIVINHA: pistas duplicadas no array clues", lambda x: (x["format"] == "ADIVINHA") & (F.size(x["clues"]) >= 2) & (F.size(F.array_distinct(norms(x))) < F.size(norms(x)))),
        riddle("ADIVINHA_CLUE_LEAKS_ANSWER", "ADIVINHA: uma pista revela ou repete a resposta", lambda x: (F.size(x["clues"]) >= 2) & F.exists(norms(x), lambda c: (c == answer(x)) | ((F.length(x["a"]) >= 3) & F.contains(c, answer(x))))),
        wrong(("CAUSA_CONSEQUENCIA",), "pergunta CAUSA_CONSEQUENCIA demasiado longa para ler em voz alta", lambda x: F.length(x["q"]) > limit(x["age"], "cause_chars")),
        wrong(("SITUACAO_PRATICA",), 'situação prática ambígua — especifica o referencial (ex.: "em relação a ti")', lambda x: has(x["q"], MOTION) & has(x["q"], WHITHER) & ~has(x["q"], FRAME)),
        wrong(("RESPOSTA_DIRETA", "ESCOLHA_MULTIPLA"), "sem setas de associação", lambda x: x["q"].contains("→") | x["q"].contains("->")),
        wrong(("RESPOSTA_DIRETA", "ESCOLHA_MULTIPLA"), 'evitar "qual não é"', lambda x: has(x["q"], r"qual\s+destes.*\bnão\b")),
        Rule("FORMAT_VIOLATION", "format", "negação múltipla", lambda x: has(x["q"], r"\bqual\s+destas\s+afirmações\s+não\s+é\s+incorreta\b")),
    ]


def category_rules() -> list[Rule]:
    other = lambda n, message, pattern: Rule("CATEGORY_MISMATCH", "category", message, lambda x: (x["category"] == n) & has(x["q"], pattern))
    return [
        other(2, "missão à Lua é Espaço/História, não Geografia", MOON),
        other(17, "veículos/transportes são Categoria 19 (Transportes), não Tecnologia", TRANSPORT),
        other(17, "espaço/foguetões são Categoria 6 (Espaço), não Tecnologia", SPACE),
        other(5, "fenómenos físicos da água/matéria são Ciência (4), não Natureza (5)", MATTER),
    ]


def portuguese_rules() -> list[Rule]:
    variant = lambda message, when: Rule("PT_BRASILISM", "ptPt", message, when)
    played = lambda pattern, message, *more: variant(message, lambda x: has(x["blob"], FOOTBALL) & reduce(lambda a, p: a & has(x["blob"], p), more, has(x["blob"], pattern)))
    soccer = lambda word: f'termo de futebol brasileiro — em PT-PT usa "{word}"'
    goal = r"(?:^|[^\w])gols?(?:[^\w]|$)"
    told = lambda x: F.concat_ws(" ", x["q"], F.array_join(x["clues"], " "))
    return [
        Rule("PT_INVALID_SCRIPT", "ptPt", "texto com caracteres não portugueses (ex.: chinês ou outro alfabeto)", lambda x: x["blob"].rlike(FOREIGN_SCRIPT)),
        Rule("PT_MIXED_WORD", "ptPt", "palavra com letras misturadas de outro idioma", lambda x: x["blob"].rlike(MIXED_WORD)),
        *[variant(message, lambda x, p=p, also=also: has(x["blob"], p) & (has(x["blob"], also) if also else F.lit(True))) for p, also, message in VARIANTS],
        variant("brasileirismo detectado — usa português de Portugal", lambda x: has(x["blob"], BRAZILIAN)),
        *[played(p, soccer(word)) for p, word in FOOTBALL_VARIANTS],
        played(r"\bmeia[s]?\b", 'termo de futebol brasileiro — em PT-PT usa "médio" (não "meia")', r"\bfutebol\b"),
        played(r"\bt[eé]cnicos?\b", soccer("treinador"), r"\bfutebol\b"),
        played(r"\btime\b", 'termo de futebol brasileiro — em PT-PT usa "equipa" (não "time")'),
        played(r"\bju[ií]zes?\b", soccer("árbitro")),
        played(r"\bcamisas?\b", 'termo de futebol brasileiro — em PT-PT usa "camisola" (não "camisa")', r"\b(futebol|jogador|equipa|clube|baliza|guarda.?redes)\b"),
        played(r"\buniformes?\b", soccer("equipamento"), r"\bfutebol\b"),
        played(r"\bpartidas?\b", soccer("jogo"), r"\bfutebol\b"),
        variant(soccer("golo"), lambda x: has(x["blob"], FOOTBALL) & has(x["blob"], goal) & ~has(x["blob"], r"\bgolfe\b")),
        played(r"\bcampo de grama\b", 'termo de futebol brasileiro — em PT-PT usa "relvado" ou "campo de relva"'),
        variant('em PT-PT usa "golo/golos" (não "gol/gols"), mesmo com "goleada" ou "golear"', lambda x: has(x["blob"], FOOTBALL) & has(x["blob"], r"\bgolead[ao]\b") & has(x["blob"], goal) & ~has(x["blob"], r"\bgolfe\b")),
        played(r"\bgolead[ao]\b", "goleada/golear em contexto de campeonato português — evita referências ao futebol brasileiro", r"\b(Brasileirão|Brasileirao|Campeonato Brasileiro|Série [AB] do Brasil)\b"),
        variant('brasileirismo — em PT-PT o papagaio de papel não se chama "pipa"', lambda x: has(x["a"], "^pipa$") & has(told(x), KITE) & ~has(told(x), NO_KITE)),
        Rule("PT_COUNTRY_NAME", "ptPt", lambda x: F.concat(F.lit('usa a mesma grafia na pergunta e na resposta — em PT-PT "'), x["spelling"], F.lit('"')), lambda x: x["spelling"].isNotNull()),
        Rule("PT_COUNTRY_NAME", "ptPt", lambda x: F.concat(F.lit('nome de país ou cidade incorrecto — em PT-PT usa "'), x["place"]["canonical"], F.lit('" (não "'), x["place"]["variant"], F.lit('")')), lambda x: x["place"].isNotNull()),
        Rule("PT_ENGLISH_ONLY", "ptPt", "resposta ou opção só em inglês — usa português de Portugal", lambda x: x["age"].isin("6-9", "10-15") & english_part(F.concat(F.array(x["q"], x["a"]), x["raw"]))),
    ]


def semantic_rules() -> list[Rule]:
    return [
        Rule("ANSWER_LEAKED", "semantic", "resposta revelada na pergunta", lambda x: (x["format"] != "VERDADEIRO_FALSO") & leaked(x["q"], x["a"])),
        Rule("PT_STEREOTYPE", "semantic", "estereótipo cultural", lambda x: has(x["q"], STEREOTYPE)),
        Rule("MULTIPLE_ANSWERS", "semantic", "possíveis múltiplas respostas", lambda x: has(F.concat_ws(" ", x["q"], x["a"]), SEVERAL)),
    ]


def families() -> dict[str, list[Rule]]:
    """All rules of items that are whole by family, in the order in which their issues are listed; the reported facts, which
    are data, come before the semantic ones."""
    few = Rule("MC_INSUFFICIENT_OPTIONS", "mcOptions", "opções MC insuficientes", lambda x: x["is_mc"] & (F.size(x["raw"]) < 2))
    options = [Rule(r.code, r.layer, r.message, lambda x, r=r: x["is_mc"] & (F.size(x["raw"]) >= 2) & r.when(x)) for r in option_rules()]
    return {"format": format_rules(), "age": age_rules(), "difficulty": difficulty_rules(), "category": category_rules(), "portuguese": portuguese_rules(), "semantic": semantic_rules(), "options": [few, *options]}


def rules() -> list[Rule]:
    return [r for family in families().values() for r in family]


INCOMPLETE = Rule("STRUCTURE_INCOMPLETE", "structural", "estrutura incompleta", lambda x: (x["q"] == "") | (x["a"] == ""))


def _issue(rule: Rule, x: Context) -> Column:
    message = F.lit(rule.message) if isinstance(rule.message, str) else rule.message(x)
    return F.when(F.coalesce(rule.when(x), F.lit(False)), F.struct(F.lit(rule.code).alias("code"), F.lit(rule.layer).alias("layer"), message.alias("message")))


@lru_cache(2)
def _issues(application: str) -> Column:
    """The issues of all families, from the columns of `context`; made once for a session, since the rules are many.

    The rules are the body of one function over one struct of what they look at. Such bodies are not compiled: code for
    some two hundred rules in one projection takes longer to compile than thousands of items take to judge."""

    def judged(x: Column) -> Column:
        found = {name: F.array_compact(F.array(*[_issue(r, x) for r in family])).cast(f"array<{ISSUE}>") for name, family in families().items()}
        last = ("semantic", "options")
        return F.concat(*[c for name, c in found.items() if name not in last], x["facts"], *[found[name] for name in last])

    item = F.struct(*[_at(name).alias(name) for name in CONTEXT])
    found = F.transform(F.array(item), lambda x: F.when(INCOMPLETE.when(x), F.array(_issue(INCOMPLETE, x)).cast(f"array<{ISSUE}>")).otherwise(F.array_distinct(judged(x))))
    return F.get(found, F.lit(0))


def with_issues(items: DataFrame) -> DataFrame:
    """items with `issues`, an array of (code, layer, message), each issue once. An item without question or answer has
    that issue alone."""
    judged = context(items).withColumn("_x_facts", F.array_distinct(reported.issues("_x_")).cast(f"array<{ISSUE}>")).withColumn("issues", _issues(items.sparkSession.sparkContext.applicationId))
    return judged.drop(*[c for c in judged.columns if c.startswith("_x_")])


def each_issue(judged: DataFrame, *columns: str) -> DataFrame:
    """The columns and `issue`, a row for each issue of items with `issues`.

    An outer explode: from an inner one Spark infers that there are issues, and moves that filter, with all rules written
    out in it, below everything to the scan, where they would be worked out once more."""
    return judged.select(*columns, F.explode_outer("issues").alias("issue")).filter("issue IS NOT NULL")


def only_difficulty(codes: Column) -> Column:
    """Whether there are codes, and all of them say that the difficulty is not the one asked for."""
    named = F.filter(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")
    return (F.size(named) > 0) & F.forall(named, lambda c: c.isin(*DIFFICULTY_CODES))
