"""Pages in languages with and without a list of stop words, and both passes against their rules read aloud."""

import itertools

import pytest

from motility.llm.html_blocks import Block, first_pass, main_text, second_pass, stops_of

PROSE = {
    "pt": [
        "A cidade cresceu muito depressa nos últimos anos e os seus moradores dizem que as ruas já não têm espaço para tantos carros, mas que o comboio é uma boa ajuda para quem trabalha longe.",
        "O presidente da câmara disse que a obra vai começar em março e que o dinheiro já está guardado para esse fim, embora alguns vizinhos ainda tenham dúvidas sobre o preço final da obra.",
        "Quem vive perto do rio espera que a ponte nova fique pronta antes do inverno, porque a água sobe todos os anos e a estrada velha fica fechada durante muitas semanas seguidas.",
    ],
    "nl": [
        "De stad is de laatste jaren snel gegroeid en veel bewoners zeggen dat er op straat geen plaats meer is voor al die auto's, maar dat de trein een goede hulp is voor wie ver weg werkt.",
        "De burgemeester zei dat het werk in maart begint en dat het geld daarvoor al klaar ligt, hoewel sommige buren nog altijd twijfelen aan de prijs die er aan het einde zal worden betaald.",
        "Wie dicht bij de rivier woont hoopt dat de nieuwe brug voor de winter klaar is, omdat het water elk jaar stijgt en de oude weg dan vele weken achter elkaar dicht blijft voor het verkeer.",
    ],
    "ru": [
        "Город за последние годы быстро вырос, и жители говорят, что на улицах больше нет места для машин, но что поезд хорошо помогает тем, кто работает далеко от дома и рано встаёт.",
        "Мэр сказал, что работы начнутся в марте и что деньги на это уже есть, хотя некоторые соседи всё ещё сомневаются в том, какой будет цена, когда мост наконец откроют для всех.",
        "Те, кто живёт у реки, надеются, что новый мост будет готов до зимы, потому что вода каждый год поднимается и старая дорога на много недель закрыта для машин и людей.",
    ],
    "zh": [
        "这座城市近年来发展得很快，居民们说街道上已经没有地方停放这么多汽车了，但是火车对那些在远处工作的人来说是一个很好的帮助，每天早上车站里都挤满了人。",
        "市长说工程将在三月开始，资金已经准备好了，虽然一些邻居对最后的价格仍然有疑问，但是大多数人都同意这座桥应该尽快修好，让大家可以安全地过河。",
        "住在河边的人希望新桥能在冬天之前完工，因为每年水位都会上涨，旧的道路会连续关闭好几个星期，孩子们只能坐很久的公共汽车去学校上课。",
    ],
    "en": [
        "The town has grown fast in the last years and those who live there say that the streets have no room for all of the cars, but that the train is a good help for all who work far away.",
        "The mayor said that the work is to begin in March and that the money for it has been put aside, while some of the neighbours are still in doubt about the price of it in the end.",
        "Those who live by the river hope that the new bridge is ready before the winter, as the water rises each year and the old road is then closed for many weeks in a row to all.",
    ],
}
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(8)) + "</ul>"


@pytest.mark.parametrize("lang", PROSE)
@pytest.mark.parametrize("linked", [0, 1, 2, 3])
def test_pages_of_any_language_come_out_whole(lang, linked):
    words = [p if k >= linked else f'{p[: len(p) // 2]}<a href="/x">{p[len(p) // 2 : len(p) // 2 + 6]}</a>{p[len(p) // 2 + 6 :]}' for k, p in enumerate(PROSE[lang])]
    body = "".join(f"<p>{w}</p>" for w in words)
    want = "\n".join(PROSE[lang])
    assert main_text(f"<body><nav>{MENU}</nav><div>{MENU}</div><div>{body}</div><footer>2024</footer></body>") == want
    assert main_text(f"<body>{MENU}<article>{body}</article>{MENU}</body>") == want


def test_formulas_and_link_items_stay_in_articles():
    page = f"<article><p>{PROSE['en'][0]}</p><p>The area of a circle is <math><mi>A</mi><mo>=</mo><mi>π</mi><annotation>A=\\pi</annotation></math> and this is so for all of them.</p><ul><li><a href='a'>First part</a> and <a href='b'>second part</a></li></ul><p>{PROSE['en'][1]}</p></article>"
    assert main_text(page).split("\n") == [PROSE["en"][0], "The area of a circle is A=π and this is so for all of them.", "First part and second part", PROSE["en"][1]]


def test_a_page_teaches_its_stop_words():
    blocks = lambda lang: [Block(p, 0, 0, False, False, False) for p in PROSE[lang]]
    assert stops_of(blocks("en"))[1] and stops_of([])[1]
    for lang, word in (("pt", "que"), ("nl", "dat"), ("ru", "что")):
        stops, known = stops_of(blocks(lang))
        assert not known and word in stops


def test_first_pass_by_its_rules():
    """All combinations of length, links, place and stop words, by the rules read aloud."""
    for n, stop_share, link_share, links, main, heading, known in itertools.product((4, 12, 30), (0.0, 0.1, 0.4), (0.0, 0.4, 0.7, 1.0), (0, 1, 5), (True, False), (True, False), (True, False)):
        ones = round(n * stop_share)
        text = " ".join(["the"] * ones + ["xyz"] * (n - ones))
        got = first_pass([Block(text, int(link_share * len(text)), links, False, main, heading)], known=known)[0]
        share, stops = int(link_share * len(text)) / len(text), ones / n
        if share > 0.5:
            want = False if not main or (share >= 0.9 and links > 3) else None
        elif n < 10 or heading:
            want = None
        elif main:
            want = True if stops >= 0.08 or not known else None
        elif stops >= 0.15 or (n >= 25 and stops >= 0.08) or (n >= 25 and not known and share <= 0.3):
            want = True
        else:
            want = False if n >= 25 and links and known else None
        assert got is want


def test_second_pass_by_search():
    for n in range(1, 6):
        for labels in itertools.product((True, False, None), repeat=n):
            for headings in itertools.product((True, False), repeat=n):
                want = []
                for i in range(n):
                    decided = [(abs(j - i), (j < i) == headings[i], j) for j in range(n) if labels[j] is not None]
                    want.append(labels[min(decided)[2]] if decided else True)
                assert second_pass(list(labels), list(headings)) == want
