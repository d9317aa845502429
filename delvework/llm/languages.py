"""A multinomial logistic regression over hashed character n-grams that tells languages apart.

Features live inside words, so a text's score is the sum of its words' scores, and scores of fragments of one
passage that lie in different pieces of a file can simply be added.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np

LABELS = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja", "none")
CJK = {"zh", "ja"}
DIM = 1 << 14

#: A few plain sentences per language from which the first labels come.
SEED = {
    "en": "The old boat leaves the harbour before the sun comes up. Nobody knows why the door was open when we came back. They have written a long letter and sent it with the first train. If you want to stay here, please close all the windows of the house. Our teacher told us which books are worth reading twice. It is not easy to find a good place for these things. She keeps every key in one box so that others can use them. After that, each of the children gets their own cup and returns to the table because it rains. Remember to write down what was said, only for those who did not hear it. While another one waits, this part must not change until the end. And how many were there without any name or number? Code generated by this tool, do not edit by hand. This file was derived from another one at build time and changes will be lost when it is created again. Produced by the compiler from its input. All rights reserved, used here under the terms of their licence and copyright. Edit the template and run it again.",
    "de": "Das alte Boot verlässt den Hafen, bevor die Sonne aufgeht. Niemand weiß, warum die Tür offen war, als wir zurückkamen. Sie haben einen langen Brief geschrieben und ihn mit dem ersten Zug geschickt. Wenn du hier bleiben willst, schließ bitte alle Fenster des Hauses. Unser Lehrer sagte uns, welche Bücher man zweimal lesen sollte. Es ist nicht leicht, einen guten Platz für diese Dinge zu finden. Danach bekommt jedes der Kinder seine eigene Tasse und geht zum Tisch zurück, weil es regnet. Vergleicht und prüft man beide Listen, so sieht jeder den Unterschied sofern noch Zeit ist. Ohne eigenen Namen und ohne Nummer gibt es nur wenige davon. Fuer die Gaeste ueber dem Fluss waere das zu spaet, damit keiner die Aenderung aeltere Eintraege verwirft. Und es ersetzt sammelt zählt oder lädt dabei veraltete doppelte Zeilen. Diese Datei wurde von einem Werkzeug erzeugt, bitte nicht von Hand bearbeiten. Automatisch erstellt, Änderungen gehen verloren. Alle Rechte vorbehalten.",
    "fr": "Le vieux bateau quitte le port avant que le soleil ne se lève. Personne ne sait pourquoi la porte était ouverte quand nous sommes revenus. Ils ont écrit une longue lettre et l’ont envoyée par le premier train. Si tu veux rester ici, ferme s’il te plaît toutes les fenêtres de la maison. Notre professeur nous a dit quels livres il faut lire deux fois. Il n’est pas facile de trouver une bonne place pour ces choses. Ensuite chacun des enfants reçoit sa propre tasse et retourne à la table parce qu’il pleut. Pour que les anciens puissent lire sans effort, elle garde toujours le même ordre. Quand cela ne convient plus, on remplace les entrées en double du fichier et on compte seulement celles qui restent. Et il renvoie vérifie trie découpe ou rassemble aucun des résultats. Fichier produit par un outil, ne pas modifier à la main. Ce fichier est créé automatiquement, toute modification sera perdue. Tous droits réservés.",
    "es": "El viejo barco deja el puerto antes de que salga el sol. Nadie sabe por qué la puerta estaba abierta cuando volvimos. Han escrito una carta larga y la enviaron con el primer tren. Si quieres quedarte aquí, cierra por favor todas las ventanas de la casa. Nuestro maestro nos dijo qué libros hay que leer dos veces. No es fácil encontrar un buen lugar para estas cosas. Después cada uno de los niños recibe su propia taza y vuelve a la mesa porque llueve. Para que nadie lo vea a medias, mantiene siempre el mismo orden. Cuando ya no coincide, descarta las líneas repetidas y guarda solo las que quedan si todavía hay espacio. Y devuelve el número de cambios, reúne revisa cuenta o recorta los títulos del archivo que no tienen contenido. Sin volver a leer todo el árbol con un carácter no válido. Archivo creado por una herramienta, no se debe editar a mano. Este archivo fue generado automáticamente y los cambios se perderán. Todos los derechos reservados.",
    "pt": "O velho barco deixa o porto antes que o sol nasça. Ninguém sabe por que a porta estava aberta quando nós voltamos. Eles escreveram uma carta longa e a enviaram com o primeiro trem. Se você quer ficar aqui, feche por favor todas as janelas da casa. O nosso professor disse quais livros devem ser lidos duas vezes. Não é fácil achar um bom lugar para essas coisas. Depois cada uma das crianças recebe a sua própria xícara e volta à mesa porque está chovendo. Para que ninguém veja pela metade, conserva sempre a mesma ordem. Quando não são mais iguais, descarta as linhas repetidas do arquivo e guarda apenas as que ainda houver. E devolve o número de mudanças, reúne verifica conta ou ordena os títulos que não têm conteúdo. Sem ler outra vez a árvore inteira com um caractere inválido, já conhecidos pelas ferramentas antigas que precisam disso. Ficheiro criado por uma ferramenta, não deve ser editado à mão. Este arquivo foi gerado automaticamente e as mudanças serão perdidas. Todos os direitos reservados.",
    "ru": "Старая лодка покидает гавань до восхода солнца. Никто не знает, почему дверь была открыта, когда мы вернулись. Они написали длинное письмо и отправили его первым поездом. Если хочешь остаться здесь, закрой, пожалуйста, все окна дома. Наш учитель сказал нам, какие книги стоит читать дважды. Нелегко найти хорошее место для этих вещей. Потом каждый из детей получает свою чашку и возвращается к столу, потому что идёт дождь. Чтобы никто не видел, она считает и сохраняет прежний порядок только для разрешённых. Файл создан программой, не изменяйте его вручную. Этот файл получен автоматически, правки будут потеряны. Все права защищены.",
    "zh": "太阳出来以前，旧船离开了港口。没有人知道我们回来的时候门为什么开着。他们写了一封很长的信，用第一班火车寄走了。如果你想留在这里，请关上房子里所有的窗户。老师告诉我们哪些书值得读两遍。给这些东西找一个好地方并不容易。然后每个孩子都拿到自己的杯子，因为下雨又回到桌子旁边。合并重复的记录，并且保持原来的顺序，仅限允许的部分，避免别人看到。统计检查忽略保留替换该文件里的内容，不必重新读取。 本文件由工具自动生成，请勿手动修改。此文件在构建时生成，改动将会丢失。保留所有权利。",
    "ja": "日が昇る前に古い船は港を出る。戻ったときなぜ扉が開いていたのか誰も知らない。彼らは長い手紙を書いて最初の列車で送った。ここに残りたいなら家の窓をすべて閉めてください。先生はどの本を二度読むべきか教えてくれた。これらの物によい場所を見つけるのは簡単ではない。そのあと子供たちは自分の茶碗をもらい、雨なので机に戻ることにした。数えてから並べ替えるため順番は変わらないようにしている。一番長い名前だけを集めるので、途中の状態は見せない。 このファイルは道具が自動で生成したものです。手で編集しないでください。変更は失われます。",
    "none": "select id path from chunks where size order by id desc limit. insert into values null update set delete from join on group by. if return else for while int const let var function def self none true false null static void. foo bar baz tmp idx ptr buf len cfg ctx src dst. usr var lib etc home bin opt srv data. http https www com org net api json xml html utf. get post put head application text plain charset. param return since type ignore noqa pylint eslint disable nolint vim sw ts todo fixme xxx. aa bb cc dd ee ff lorem d f s x y z.",
}

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
CJK_RUN = re.compile(r"[々-〇぀-ヿ㐀-䶿一-鿿豈-﫿]+")


@lru_cache(maxsize=50_000)
def features(word: str) -> list[int]:
    """Hashed n-grams of a word: one to four characters with word ends, one and two for CJK."""
    if _CJK.match(word):
        grams = [*word, *(word[i : i + 2] for i in range(len(word) - 1))]
    else:
        w = f"<{word.lower().replace('’', chr(39))}>"
        grams = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
        grams.append(w)
    return [zlib.crc32(g.encode()) % DIM for g in grams]


class Model:
    """Weights (DIM x labels) and biases, with a bounded cache of word scores."""

    CACHE = 50_000

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias, self.cache = weights, bias, {}

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def word(self, word: str) -> np.ndarray:
        v = self.cache.get(word)
        if v is None:
            v = self.weights[features(word)].sum(axis=0)
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[word] = v
        return v

    def score(self, words: list[str]) -> np.ndarray:
        """Sum of the words' scores, without the bias: additive over fragments of a passage."""
        if not words:
            return np.zeros(len(LABELS), np.float32)
        return np.sum([self.word(w) for w in words], axis=0)

    def label(self, score: np.ndarray) -> str:
        return LABELS[int(np.argmax(score + self.bias))]


def words_of(text: str) -> list[str]:
    """Words of a text; a run of CJK characters is one."""
    return [p for w in WORD.findall(text) for p in (_split(w) if _CJK.search(w) else (w,))]


def _split(word: str) -> list[str]:
    return [p for p in re.split(r"([々-〇぀-ヿ㐀-䶿一-鿿豈-﫿]+)", word) if p]


def fit(texts: list[str], labels: list[str], epochs: int = 8, rate: float = 0.3, scale: float = 0.05) -> Model:
    """Multinomial logistic regression by AdaGrad; deterministic."""
    rng = np.random.default_rng(7)
    rows = []
    for text, label in zip(texts, labels):
        f = [h for w in words_of(text) for h in features(w)]
        if f:
            ids, n = np.unique(np.asarray(f), return_counts=True)
            rows.append((ids, n.astype(np.float32) * scale, LABELS.index(label)))
    w, g2 = np.zeros((DIM, len(LABELS)), np.float32), np.full((DIM, len(LABELS)), 1e-2, np.float32)
    b = np.zeros(len(LABELS), np.float32)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, n, y = rows[i]
            z = n @ w[ids] + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = np.outer(n, p)
            g2[ids] += grad * grad
            w[ids] -= rate * grad / np.sqrt(g2[ids])
            b -= 0.01 * p
    return Model(w * scale, b)


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n+", text) if s.strip()]


def seed_rows() -> tuple[list[str], list[str]]:
    """Sentences of the seed and halves of them, so that short texts occur as well."""
    xs, ys = [], []
    for label, text in SEED.items():
        for s in sentences(text):
            parts = [s]
            if len(s.split()) > 5:
                k = s.split()
                parts += [" ".join(k[: len(k) // 2]), " ".join(k[len(k) // 2 :])]
            xs += parts
            ys += [label] * len(parts)
    return xs, ys


def train(unlabelled: list[str] = (), least: int = 5) -> Model:
    """A model from the seed, then refitted with further texts that the first model labels."""
    xs, ys = seed_rows()
    first = fit(xs, ys)
    more = [s for t in unlabelled for s in sentences(t)]
    for s in more:
        ws = words_of(s)
        if len(ws) >= least or any(len(w) >= 8 and _CJK.match(w) for w in ws):
            sc = np.sort(first.score(ws) + first.bias)
            if sc[-1] - sc[-2] > 0.5:
                xs.append(s)
                ys.append(first.label(first.score(ws)))
    return fit(xs, ys, epochs=4) if more else first
