"""Function words of the five languages."""

from __future__ import annotations

# fixed values: frequent function words (articles, pronouns, prepositions, conjunctions, auxiliaries, particles)
FUNCTION_WORDS = {
    "hu": "a az egy és is nem hogy ha de meg már csak még mert ki mi te én ő mit aki ami amely amit akit amelyet azt ezt ez ezek azok volt van vagy lesz lett mint minden sem se sok után előtt alatt között szerint által alapján ahol amikor mikor midőn ekkor akkor hol miért pedig aztán majd hiszen bár s e ó jaj is itt ott így úgy mind sincs nincs valamint illetve annak ennek attól arra erre abban ebben azzal ezzel össze fel le el be vissza senki semmi valaki valami nélkül felé nekem neki velem vele éve nevű számú bizony",
    "en": "the a an and or but not no of to in on at by for with from as is was were be been are has have had do does did this that these those it its he she they we you i my your his her their our who whom whose which what when where why how if then than so because although while since until before after under over between into out up down there here will would shall should may might can could must whatever nobody someone nothing me him them us also only very",
    "de": "der die das ein eine einen einem einer eines und oder aber nicht kein keine ist war waren sind sein haben hatte hatten wird werden wurde wurden ich du er sie es wir ihr mir mich dir dich ihm ihn uns von vom zu zum zur in im am an auf aus bei mit nach für durch gegen ohne um über unter vor als wenn dass weil ob wie was warum wer wo noch nur schon sehr auch so nie seit des den dem doch dann hier dort nichts niemand",
    "fr": "le la les un une des et ou mais ne pas est sont était étaient été être a ont avait avons avez ai je tu il elle on nous vous ils elles me m te se s lui leur y en de du d au aux à dans sur sous par pour avec sans ce cet cette ces c qui que qu quoi dont où quand si comme plus très tout tous toute rien ici là déjà depuis pendant personne l n j mon ma mes son sa ses notre votre",
    "es": "el la los las un una unos unas y o pero no es son era eran fue ser estar está estaba ha han había he yo tú él ella nosotros ellos me te se le lo les nos mi su sus tu de del al a en con por para sin sobre entre hasta desde que qué quien cuando donde como si aunque porque más muy todo todos nada nadie hace ya aquí allí estos estas ese esa aquel aquella sé",
}
LANGUAGES = tuple(FUNCTION_WORDS)
LEXICON = {lang: frozenset(ws.split()) for lang, ws in FUNCTION_WORDS.items()}
COMMON = frozenset().union(*LEXICON.values())
