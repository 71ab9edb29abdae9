"""Rules for facts and wordings that players reported: data, found through an index of the words they cannot do without."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip_accents


class Reported(NamedTuple):
    """A rule: patterns that question (q), answer (a), options (o) or answer and options (ao) have to hold, or must not
    (not_q, ...). Options are lines of one text. One of the anchors is in the question or the answer of every item that
    the rule is about; without anchors it is tried on all items of its format."""

    code: str
    layer: str
    message: str
    anchors: str = ""
    q: tuple[str, ...] = ()
    a: tuple[str, ...] = ()
    o: tuple[str, ...] = ()
    ao: tuple[str, ...] = ()
    not_q: tuple[str, ...] = ()
    not_a: tuple[str, ...] = ()
    not_ao: tuple[str, ...] = ()
    format: str = ""


# --- fixed values: the reported rules, in order --------------------------------------------------------------------------

S, F_ = "semantic", "factual"
RULES = (
    Reported("FACT_01_PERGUNTA_AMBIGUA_WOODY_E_JES", S, 'pergunta ambígua — Woody e Jessie usam chapéu de cowboy; especifica "xerife", "vaqueira" ou outro detalhe único', "toy", q=(r"\btoy\s*story\b", r"\b(chapéu|chapeu)\b", r"\b(cowboy|vaqueir|xerife)\b")),
    Reported("FACT_02_PERGUNTA_AMBIGUA_EM_PT_PT_US", S, 'pergunta ambígua — em PT-PT usa "Ursinho Puff" de forma única (não Pooh/Winnie em separado)', "disney|desenho", q=(r"\b(ursinho|urso)\b.*\bmel\b|\bmel\b.*\b(ursinho|urso)\b", r"\b(disney|desenho)\b"), ao=(r"\b(pooh|winnie|puff)\b",)),
    Reported("FACT_03_PERGUNTA_AMBIGUA_MAIS_DO_QUE", S, "pergunta ambígua — mais do que um personagem encaixa na descrição", "woody", q=(r"\bqual\s+(personagem|herói|heroi)\b", r"\b(chapéu|chapeu|óculos|oculos|veste|usa)\b"), not_q=(r"\b(único|unico|só\s+ele|so\s+ele|principal|xerife|vaqueira)\b",), a=(r"\bwoody\b",), o=(r"\bjessie\b",)),
    Reported("FACT_04_PERGUNTA_AMBIGUA_VARIOS_ANIM", S, "pergunta ambígua — vários animais marinhos/aves dormem com um olho aberto; especifica espécie ou contexto", "golfinho|baleia|pato|foca", q=(r"\b(olho aberto|metade do cérebro|metade do cerebro|unihemisfério|unihemisferio)\b",), a=(r"\b(golfinho|baleia|pato|foca)\b",)),
    Reported("FACT_05_RESPOSTA_MASCULINA_INCOMPATI", S, 'resposta masculina incompatível com "primeira mulher"', "primeira", q=(r"\b(primeira\s+mulher|primeira\s+realizadora)\b",), a=(r"\b(steven|spielberg|scorsese|nolan|cameron|tarantino|hitchcock|kubrick)\b",)),
    Reported("FACT_06_PERGUNTA_CONTRADITORIA_PRIME", S, 'pergunta contraditória — "primeira mulher" com "realizador"', "primeira", q=(r"\b(primeira\s+mulher|primeira\s+realizadora)\b", r"\brealizador\b"), not_q=(r"\brealizadora\b",)),
    Reported("FACT_07_FACTO_INCORRETO_A_LISTA_DE_S", F_, "facto incorreto — A Lista de Schindler não se liga ao primeiro Óscar de melhor realizadora", "schindler", q=(r"\blista de schindler\b", r"\bprimeira\s+mulher\b")),
    Reported("FACT_08_RESPOSTA_NAO_CORRESPONDE_A_D", S, "resposta não corresponde à descrição de tamanho", "zebra", q=(r"\b(4[,.]5\s*metros?|metros?\s+de\s+altura|mais\s+alto|altura.*ombros)\b", r"\b(maior|animal\s+terrestre)\b", r"\b(giraf|elefant|altura|ombros|4)\b"), a=(r"\bzebra\b",)),
    Reported("FACT_09_ZEBRA_NAO_E_O_MAIOR_ANIMAL_T", S, "zebra não é o maior animal terrestre", "zebra", q=(r"\bmaior animal terrestre\b",), a=(r"\bzebra\b",)),
    Reported("FACT_10_NA_CHUVA_O_ACESSORIO_USUAL_E", S, "na chuva, o acessório usual é guarda-chuva ou impermeável, não luvas", "acessório", q=(r"\b(chove|chuva)\b", r"\b(mãos|maos)\b", r"\bacessório\b"), a=(r"\b(luvas|gorro|cachecol)\b",)),
    Reported("FACT_11_PERGUNTA_VAGA_TRACO_FISICO_G", S, "pergunta vaga — traço físico genérico não identifica uma pessoa de forma única", "cabelo|olhos", q=(r"\b(cabelo|olhos)\s+(castanh|azul|verde|loiro|ruivo)\b", r"\b(artista|cantor|pianista|músico|música)\b")),
    Reported("FACT_12_DEFINICAO_CIRCULAR_OU_DEMASI", S, 'definição circular ou demasiado vaga no "O que é"', "imagem|tipo|forma", q=(r"^o\s+que\s+é\s+(um|uma)\s+",), a=(r"^(imagem\s+de|tipo\s+de|forma\s+de)\b",)),
    Reported("FACT_13_RESPOSTA_FACTUALMENTE_ERRADA", F_, "resposta factualmente errada — arco-íris é um fenómeno da luz e da água no céu", "arco", q=(r"\barco[-\s]?íris|arco[-\s]?iris\b",), a=(r"\b(desenho|pintura|nuvem|animal|fruta|planta)\b",)),
    Reported("FACT_14_DEFINICAO_ERRADA_NAO_CONFUND", F_, 'definição errada — não confundir fenómeno natural com "desenho" ou "pintura"', "desenho|pintura", q=(r"^o\s+que\s+é\s+(um|uma)\s+",), a=(r"\b(desenho|pintura)\s+de\s+(cores|luz)\b",)),
    Reported("FACT_15_BICA_E_GALAO_DIFEREM_SOBRETU", S, "bica e galão diferem sobretudo na proporção de leite — pergunta ambígua", "bica|galão", q=(r"\b(bica|galão)\b", r"\balém\b.*\bproporção\b"), a=(r"\bcafé\b",)),
    Reported("FACT_16_PERGUNTA_AMBIGUA_MAPA_E_GLOB", S, "pergunta ambígua — mapa e globo terráqueo respondem às mesmas pistas", "montanhas", q=(r"\bcidades\b", r"\bn[aã]o\s+casas\b", r"\bmontanhas\b", r"\bn[aã]o\s+(árvores|arvores)\b", r"\b(água|agua)\b", r"\bn[aã]o\s+peixes\b"), ao=(r"\bmapa\b",), o=(r"\bglobo\b",)),
    Reported("FACT_17_FACTO_INCORRETO_O_PASTEL_DE_", F_, "facto incorreto — o pastel de nata associa-se a Belém/Lisboa", "pastel", q=(r"\bpastel\s+de\s+nata\b", r"\b(cidade|onde|fica|nasceu|origem|populariz|criado|inventado)\b"), not_a=(r"\b(lisboa|bel[eé]m)\b",)),
    Reported("FACT_18_FACTO_INCORRETO_A_FRANCESINH", F_, "facto incorreto — a francesinha é típica do Porto", "francesinha", q=(r"\bfrancesinha\b", r"\b(cidade|onde|fica|origem|nasceu|típic[ao])\b"), not_a=(r"\bporto\b",)),
    Reported("FACT_19_FACTO_CULTURAL_A_CHITA_ASSOC", F_, "facto cultural — a chita associa-se sobretudo a Alcobaça; não confundir com o traje de Viana sem contexto histórico claro", "chita", q=(r"\bchita\b", r"\btraje\b", r"\bviana\b")),
    Reported("FACT_20_PERGUNTA_AMBIGUA_VARIOS_PRAT", S, "pergunta ambígua — vários pratos de bacalhau são igualmente defensáveis; indica um prato específico", "bacalhau", q=(r"\bbacalhau\b", r"\b(prato|pratos|típic[oa]s?)\b"), ao=(r"\bbacalhau\b[^\n]*\n[\s\S]*\bbacalhau\b",)),
    Reported("FACT_21_TEMA_ASTRONOMICO_DEMASIADO_T", S, "tema astronómico demasiado técnico ou obscuro para o jogo", "pulsar", q=(r"\bpulsar\b", r"\bpsr\b|\bplaneta\b.*\b[óo]rbita\b|\bpulsa[çc][õo]es\b")),
    Reported("FACT_22_FACTO_INCORRETO_EDDY_MERCKX_", F_, "facto incorreto — Eddy Merckx não venceu o Tour de 1975 (vencedor: Bernard Thévenet)", "merckx", q=(r"\bmerckx\b", r"\b1975\b", r"\btour\s+de\s+france\b", r"\bvenceu\b")),
    Reported("FACT_23_FACTO_DUVIDOSO_VANTAGENS_NO_", F_, "facto duvidoso — vantagens no ciclismo medem-se em minutos ou horas, não em dias", "dias", q=(r"\b(vantagem|diferen[çc]a)\b", r"\b\d+\s+dias\b", r"\b(tour|ciclismo|ciclista|volta)\b")),
    Reported("FACT_24_INCONSISTENCIA_DE_GENERO_A_P", S, "inconsistência de género — a pergunta pede uma mulher mas a resposta é um nome masculino", "engenheira|actriz|atriz|inventora|escritora|diretora|realizadora", q=(r"\b(a|uma)\s+(engenheira|actriz|atriz|inventora|escritora|diretora|realizadora)\b",), a=(r"\b(dario|martin|james|john|robert|leonardo|quentin|stanley|heath|elon|ray|hiroshi)\b",)),
    Reported("FACT_25_FACTO_INCORRETO_ROALD_DAHL_N", F_, 'facto incorreto — Roald Dahl não escreveu "O rato que queria ser rei"', "roald", q=(r"\broald\s+dahl\b", r"\brato\b", r"\b(queria\s+ser|ser)\s+rei\b")),
    Reported("FACT_26_ERRO_ORTOGRAFICO_ESCREVE_ASF", S, 'erro ortográfico — escreve "asfalto" (não "asfato")', "asfato", a=(r"\basfato\b",), not_a=(r"\basfalto\b",)),
    Reported("FACT_27_FORMULACAO_ESTRANHA_DIZ_ESTR", S, 'formulação estranha — diz "estrada" ou "piso da estrada", não "estrada para os carros"', "estrada", q=(r"\bestrada\s+para\s+os\s+carros\b",)),
    Reported("FACT_28_RESPOSTA_AMBIGUA_ASFALTO_E_A", S, "resposta ambígua — asfalto e alcatrão são ambos aceitáveis em PT-PT; reformula ou escolhe outro tema", "asfalto|alcatr|betume", q=(r"\b(estrad|autoestrada)\b", r"\bfeit[ao]\s+de\b"), a=(r"\b(asfalto|alcatrão|alcatrao|betume)\b",)),
    Reported("FACT_29_PERGUNTA_CONFUSA_RATO_QUE_FA", S, 'pergunta confusa — "rato que faz queijo" é o Remy (Ratatouille), não o Mickey nem outros personagens clássicos', "queijo", q=(r"\b(rato|ratos)\b", r"\bqueijo\b", r"\b(disney|pixar|filme)\b"), not_ao=(r"\b(remy|rémy|ratatouille)\b",)),
    Reported("FACT_30_FACTO_INCORRETO_O_RATO_QUE_C", F_, "facto incorreto — o rato que cozinha/faz queijo é o Remy (Ratatouille), não o Mickey", "queijo", q=(r"\b(rato|ratos)\b", r"\bqueijo\b", r"\b(disney|pixar|filme)\b"), a=(r"\bmickey\b",)),
    Reported("FACT_31_FACTO_DUVIDOSO_DESIGNER_OBRA", F_, "facto duvidoso — designer/obras de moda portuguesa obscuras; prefere temas verificáveis (ex.: Nuno Gama)", "manuel", q=(r"\b(sapatilha|sapato)\b", r"\b(salto|madeira)\b", r"\b(designer|criou|criador|famoso)\b"), a=(r"\bmanuel\s+branco\b",)),
    Reported("FACT_32_PERGUNTA_CONFUSA_PATO_DE_BOR", S, "pergunta confusa — pato de borracha não tem penas reais; reformula a adivinha", "borracha", q=(r"\b(asas|asa)\b", r"\b(penas|pena)\b", r"\bn[aã]o\s+voa\b"), a=(r"\bpato\s+de\s+borracha\b",)),
    Reported("FACT_33_FACTO_DISPUTADO_COMPRIMENTO_", F_, "facto disputado — comprimento do Nilo vs Amazónia varia conforme a medição; evita V/F absoluto", "nilo", q=(r"\bnilo\b", r"\b(mais\s+longo|maior\s+rio)\b", r"verdadeiro\s+ou\s+falso")),
    Reported("FACT_34_FACTO_DESPORTIVO_ESPECIFICO_", F_, "facto desportivo específico do Mundial 2026 não verificável — evita golos/jogadores desse torneio", "2026", q=(r"\b(copa\s+do\s+mundo|mundial)\b", r"\b2026\b", r"\b(golo|golos|marcou|jogador|sele[cç][ãa]o)\b")),
    Reported("FACT_35_TERMO_BRASILEIRO_EM_PT_PT_US", F_, 'termo brasileiro — em PT-PT usa "Mundial" ou "Campeonato do Mundo"', "copa", q=(r"\bcopa\s+do\s+mundo\b",)),
    Reported("FACT_36_PERGUNTA_VAGA_CHAPEU_E_OCULO", S, "pergunta vaga — chapéu e óculos não identificam um cantor de forma única", "óculos|oculos", q=(r"\b(chapéu|chapeu)\b", r"\b(óculos|oculos)\b", r"\b(canta|cantor|cantora|festival)\b")),
    Reported("FACT_37_PERGUNTA_CONFUSA_EVITA_O_QUE", S, 'pergunta confusa — evita "O que é a [parte] da planta/árvore?"; reformula (ex.: "Para que serve a flor?")', "flor|folha|raiz|tronco|casca|semente|fruto|galho", format="O_QUE_E", q=(r"^o\s+que\s+é\s+(?:a|o|um|uma)\s+(flor|folha|raiz|tronco|casca|semente|fruto|galho)\s+(?:d[aeo]s?\s+)(?:planta|árvore|arvore|flor)\b",)),
    Reported("FACT_38_PERGUNTA_CIRCULAR_A_RESPOSTA", S, "pergunta circular — a resposta repete a palavra que se pede para definir", format="O_QUE_E", q=(r"^o\s+que\s+é\s+(?:a|o|um|uma)\s+(\w+)\s+(?:d[aeo]s?\s+)(\w+)",)),
    Reported("FACT_39_ADIVINHA_SEM_RESPOSTA", "format", "adivinha sem solução registada — não publicar", "resposta", a=(r"^\s*sem\s+resposta\s*$",)),
    Reported("FACT_40_AVIÃO_COM_PENAS", S, "adivinha incoerente — avião não tem penas; reformula ou muda a resposta", "penas", q=(r"\bpenas\b", r"\bn[aã]o\s+[eé]\s+um\s+p[aá]ssaro\b"), a=(r"\bavi[aã]o\b",)),
    Reported("FACT_41_RELOGIO_DENTES", S, "adivinha clássica dos dentes — resposta correcta é pente, não relógio", "dentes", q=(r"\bdentes\b", r"\bn[aã]o\s+morde?\b"), a=(r"\brel[oó]gio\b",), not_a=(r"\bpente\b",)),
    Reported("FACT_42_CAO_NAO_E_BURRO", S, "pergunta errada — Burro/Donkey não é um cão; reformula", "shrek|donkey|burro", q=(r"\bc[aã]o\b",), a=(r"\b(shrek|donkey|burro)\b",)),
    Reported("FACT_43_CRAVOS_LIDER_AMBIGUO", S, "pergunta ambígua — vários intervenientes no 25 de Abril; especifica o papel (ex.: comandante operacional)", "otelo", q=(r"\brevolu[cç][aã]o\s+dos\s+cravos\b", r"\bl[ií]der\b"), a=(r"\botelo\b",)),
    Reported("FACT_44_COSTAS_ALFINETE", S, "resposta errada — cadeira tem costas; alfinete não encaixa nas pistas", "alfinete", q=(r"\bcostas\b", r"\bn[aã]o\s+tenho\s+corpo\b"), a=(r"\balfinete\b",)),
    Reported("FACT_45_FUTRE_FINAL_1998", F_, "facto incorrecto — na final da Champions 1998 marcou Predrag Mijatović, não Paulo Futre", "futre", q=(r"\b1998\b", r"\bliga\s+dos\s+campe[oõ]es\b", r"\bfinal\b"), a=(r"\bpaulo\s+futre\b",)),
    Reported("FACT_46_PADRAO_VAGO", S, "pergunta vaga — especifica o objecto (ex.: pilha, barber pole, pastilha elástica)", "padrão|padrao", q=(r"\bpadr[aã]o\s+vermelho,\s*branco,\s*vermelho\b",)),
    Reported("FACT_47_MOZART_HAYDN_OBSCURO", S, "pergunta demasiado obscura — simplifica ou escolhe outro tema musical", "haydn", q=(r"\bromper\s+com\s+haydn\b", r"\b1781\b")),
    Reported("FACT_48_CABRA_MILHO_ADIVINHA", S, "resposta folclórica ambígua (brincadeira oral) — não adequada ao jogo", "cabra", q=(r"\bcomer\s+me\s+qu.*rias\b",), a=(r"\bcabra\b.*\b(milho|centeio|trigo)\b",)),
)
CIRCULAR = "FACT_38_PERGUNTA_CIRCULAR_A_RESPOSTA"
CONFUSING = r"(?i)pergunta confusa|formulação|resposta ambígua — asfalto|pergunta circular"
CONFUSING_PREFIXES = r"pergunta confusa|formulação|resposta ambígua — asfalto|pergunta circular"

# --- from data to columns --------------------------------------------------------------------------------------------------

#: Case and word boundaries are those of Unicode on every version of Java.
FLAGS = "(?iuU)"


@lru_cache(1)
def anchors() -> tuple[str, ...]:
    return tuple(dict.fromkeys(word for rule in RULES for word in rule.anchors.split("|") if word))


def found_anchors(q: Column, a: Column) -> Column:
    """The anchors that an item's question and answer hold, in one pass over them; words may go on after an anchor."""
    either = "|".join(sorted(map(re.escape, anchors()), key=len, reverse=True))
    return F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws("\n", q, a), F.lit(rf"{FLAGS}\b({either})"), F.lit(1)), F.lower))


def fields(q: Column, a: Column, options: Column) -> dict[str, Column]:
    """What the rules look at besides question and answer, by name. Null texts hold nothing."""
    plain = lambda x: strip_accents(F.lower(x))
    line = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" "))
    lines = F.transform(F.coalesce(options, F.array().cast("array<string>")), line)
    circular = next(r for r in RULES if r.code == CIRCULAR).q[0]
    return {
        "o": F.array_join(lines, "\n"),
        "ao": F.array_join(F.concat(F.array(line(a)), lines), "\n"),
        "anchors": found_anchors(q, a),
        "term": plain(F.regexp_extract(q, f"{FLAGS}{circular}", 1)),
        "first": F.regexp_extract(F.trim(plain(a)), r"^(\S*)", 1),
    }


def _condition(rule: Reported, prefix: str, indexed: bool) -> str:
    holds = lambda name, pattern: f'{prefix}{name} RLIKE r"{FLAGS}{pattern}"'
    tests = [f"{prefix}format = '{rule.format}'"] if rule.format else []
    if indexed and rule.anchors:
        tests.append(f"arrays_overlap({prefix}anchors, array({', '.join(repr(w) for w in rule.anchors.split('|'))}))")
    tests += [holds(name, p) for name in ("q", "a", "o", "ao") for p in getattr(rule, name)]
    tests += [f"NOT ({holds(name, p)})" for name in ("q", "a", "ao") for p in getattr(rule, f"not_{name}")]
    if rule.code == CIRCULAR:
        tests.append(f"{prefix}term <> '' AND {prefix}term = {prefix}first")
    return " AND ".join(tests)


def issues(prefix: str = "", indexed: bool = True) -> Column:
    """Array of (code, layer, message) of the reported rules that an item breaks, in order, from the columns q, a, format
    and those of `fields`, each with the prefix.

    Which anchors a text holds is found in one pass, and a rule is tried only if one of its own is there; most items hold
    none. The rules are one SQL text made from data, so a rule more is a row more of the table. `indexed=False` tries
    every rule on every item, with the same result."""
    rows = [f"IF({_condition(r, 'x.', indexed)}, named_struct('code', '{r.code}', 'layer', '{r.layer}', 'message', '{r.message}'), NULL)" for r in RULES]
    looked_at = ", ".join(f"'{name}', {prefix}{name}" for name in ("q", "a", "format", "o", "ao", "anchors", "term", "first"))
    # the body of a function is not compiled, see items
    return F.expr(f"get(transform(array(named_struct({looked_at})), x -> array_compact(array({', '.join(rows)}))), 0)")


def confusing(code: Column, message: Column) -> Column:
    """Whether an issue says that an item confuses rather than that it is wrong."""
    return F.coalesce(code.isin(*[r.code for r in RULES if re.search(CONFUSING, r.message)]), F.lit(False)) | F.coalesce(message.rlike(f"^({CONFUSING_PREFIXES})"), F.lit(False))


def factual(found: Column) -> Column:
    """The issues that say an item is wrong: neither confusing nor merely ambiguous."""
    return F.filter(found, lambda i: ~confusing(i["code"], i["message"]) & ~F.startswith(i["message"], F.lit("pergunta ambígua")))
