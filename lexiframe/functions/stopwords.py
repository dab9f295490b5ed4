"""Function words of four languages: articles, pronouns, prepositions, conjunctions, auxiliaries.

Plain data, so that the engine and its checks share it without a session or a jar.
"""

from __future__ import annotations

WORDS = {
    "en": (
        "a an the this that these those i me my mine myself you your yours yourself yourselves he him his "
        "himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves "
        "who whom whose which what where when why how and but or nor so yet if because as until while although "
        "though unless of at by for with about against between into through during before after above below to "
        "from up down in out on off over under again further then once here there all any both each few more "
        "most other some such no not only own same than too very am is are was were be been being have has had "
        "having do does did doing will would shall should can could may might must"
    ),
    "fr": (
        "le la les un une des du de d l au aux ce cet cette ces mon ma mes ton ta tes son sa ses notre nos votre "
        "vos leur leurs je tu il elle on nous vous ils elles me te se moi toi lui eux y en qui que quoi dont où "
        "et ou mais donc or ni car si comme quand lorsque puisque à dans par pour sur avec sans sous vers chez "
        "entre contre depuis pendant ne pas plus moins très aussi même tout tous toute toutes suis es est sommes "
        "êtes sont étais était étaient été être ai as a avons avez ont avais avait avaient eu avoir sera seront"
    ),
    "de": (
        "der die das den dem des ein eine einen einem einer eines dieser diese dieses diesen diesem jener jene "
        "ich du er sie es wir ihr mich dich sich uns euch mir dir ihm ihnen mein meine dein deine sein seine "
        "unser unsere euer eure wer wen wem was welche welcher welches und oder aber denn sondern wenn weil dass "
        "daß ob als wie während bis in im an am auf aus bei beim mit nach von vom vor zu zum zur für durch gegen "
        "ohne um über unter zwischen hinter neben nicht kein keine nur auch noch schon sehr so da hier dort bin "
        "bist ist sind seid war waren gewesen werde wird werden wurde wurden habe hat haben hatte hatten kann "
        "können muss müssen soll sollen will wollen"
    ),
    "es": (
        "el la los las un una unos unas lo al del este esta estos estas ese esa esos esas aquel aquella yo tú él "
        "ella nosotros vosotros ellos ellas me te se nos os le les mi mis tu tus su sus nuestro nuestra que quien "
        "quienes cual cuales cuyo donde cuando como y e o u pero sino aunque porque si ni de a en con sin por "
        "para sobre entre hasta desde hacia contra durante según no sí más menos muy también ya todo todos toda "
        "todas soy eres es somos son era eran fue fueron ser sido estoy está están estaba estaban he ha han "
        "había habían hay tiene tienen"
    ),
}


def stopwords(lang: str) -> list[str]:
    return sorted(set(WORDS[lang].split()))
