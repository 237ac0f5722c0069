"""Terms of error messages, access refusals and demands for scripts by meaning, and the combinations that make a message.

A sentence is a message by what its terms mean together, not by a phrase: something lost or not found beside a page or an
address, an access that is denied, scripts beside a demand to switch them on, and so on, in any of the languages listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick

# Terms by meaning. A star stands for any ending; a comma ends a term. Languages in turn: en, de, fr, es, it, pt, nl, pl, ru, uk, tr, sv, da, cs, zh, ja, ko, ar.
TERMS = {
    "not": """not, n't, n’t, cannot, no, nothing, unable, nicht, kein*, nichts, n'*, n’*, pas, plus, aucun*, impossible, ningun*, ningún, nada, imposible, non, nessun*, impossibile, não, nenhum*, niet, geen, nie, не, нет, нема*,
        değil, yok, inte, ingen, ikke, není, nelze, 不, 没, 沒, 无, 無, 未, ません, ない, なかった, 없, 않, 못, لا, لم, غير, يتعذر""",
    "find": """found, find, locate, located, looked for, looking for, searched for, gefunden, finden, trouv*, encontr*, hallad*, hallar, trovat*, trovar*, gevonden, vinden, znale*, найден*, найти, знайден*, знайти, bulun*, hitt*, fundet, funnet, nalezen*,
        找到, 見つか, 찾, العثور""",
    "exist": "exist, exists, existed, existier*, existe, existen, existent, esist*, bestaat, istnie*, существу*, існу*, finns, findes, finnes, existuj*, 存在, 존재, موجود*",
    "open": """open, opened, load, loaded, show, shown, display, displayed, reach, reached, retrieve*, öffnen, geöffnet, laden, geladen, anzeigen, angezeigt, erreichen, ouvrir, ouvert*, charger, chargé*, afficher, affich*, abrir, cargar, cargó,
        mostrar, aprire, aperta, caricare, caricat*, mostrare, carregar, exibir, openen, getoond, otworzy*, wyświetl*, załadow*, открыть, загруз*, отобраз*, показать, відкри*, açıl*, yüklen*, görüntülen*, öppna*, visas, åbnes, otevřít, zobraz*,
        打开, 打開, 加载, 載入, 显示, 顯示, 表示, 開く, 開け, 読み込, 열, 표시""",
    "available": "available, reachable, accessible, verfügbar, erreichbar, vorhanden, disponib*, disponív*, accessibl*, accesibl*, raggiungibil*, acessív*, beschikbaar, bereikbaar, dostępn*, доступн*, mevcut, tillgänglig*, tilgængelig*, dostupn*, 可用, 利用でき, ご利用, 이용",
    "lost": """missing, gone, unavailable, been deleted, was deleted, been removed, was removed, been moved, was moved, has moved, expired, been retired, been withdrawn, entfernt, gelöscht, verschoben, abgelaufen, nichtgefunden, unauffindbar, unerreichbar, introuvable*, inexistant*, inaccessible*, supprim*, déplacé*, expiré*, eliminad*, borrad*, movid*, trasladad*,
        inexistent*, inaccesible*, caducad*, expirad*, rimoss*, eliminat*, spostat*, scadut*, irraggiungibil*, removid*, apagad*, excluíd*, verwijderd, verplaatst, verlopen, usunięt*, przeniesion*, wygas*, niedostępn*, удал*, перемещ*, недоступ*, истек*, видален*, переміщен*,
        bulunamad*, kaldırıl*, taşın*, silin*, borttag*, flyttat*, slettet, flyttet, nenalezen*, neexistuj*, nedostupn*, odstraněn*, 不存在, 已删除, 已刪除, 已移动, 已失效, 过期, 過期, 削除, 移動しま, 切れ, 삭제, 이동되, 만료, حذف""",
    "thing": """page, file, document, site, website, url, address, link, resource, content, article, record, what you, you were, you are looking, seite, website, datei, adresse, inhalt, inhalte, dokument, eintrag, artikel, fichier, contenu, lien, página, archivo, sitio, dirección, contenido, documento,
        enlace, pagina, sito, indirizzo, risorsa, contenuto, arquivo, endereço, conteúdo, recurso, bestand, adres, inhoud, stron*, plik*, zasób, страниц*, файл*, адрес*, сайт*, документ*, ресурс*, сторінк*, sayfa*, dosya*, sida, sidan, filen, side, siden, stránk*, soubor*,
        页面, 页, 網頁, 頁面, 网站, 網站, 文件, 地址, 网址, 内容, 內容, ページ, サイト, ファイル, アドレス, 記事, コンテンツ, 페이지, 사이트, 파일, 주소, صفحة, الصفحة, الموقع""",
    "server": "server*, gateway, service, serveur*, servidor*, dienst*, servizio, serviço, serwer*, usługa, сервер*, сервис*, sunucu*, tjänst*, tjeneste*, služb*, 服务器, 伺服器, 服务, 服務, サーバ*, サービス, 서버, 서비스, الخادم",
    "deny": """denied, forbidden, unauthori*, refused, rejected, blocked, banned, restricted, disallowed, verweigert, verboten, gesperrt, abgelehnt, blockiert, refusé*, interdit*, bloqué*, denegad*, prohibid*, rechazad*, bloquead*, restringid*, negat*, vietat*, bloccat*, negad*, proibid*, recusad*,
        geweigerd, verboden, geblokkeerd, odmów*, odmow*, zabronion*, zablokowan*, запрещ*, запрет*, отказан*, заблокир*, заборон*, відмовлен*, engellen*, reddedil*, yasak*, nekad*, nekas, förbjud*, blockera*, nægtet, forbudt, blokeret, odepřen*, zakázán*, zablokován*,
        拒绝, 拒絕, 禁止, 拒否, ブロック, 거부, 금지, 차단, مرفوض, محظور""",
    "access": """access, permission, permissions, rights, request, requests, zugriff*, zugang, berechtigung*, rechte, anfrage*, accès, autorisation*, droits, requête*, acceso, permiso*, solicitud*, petici*, accesso, permess*, richieste, richiesta, acesso, permiss*, pedido*, toegang, rechten, verzoek*, dostęp*, uprawnie*, żąda*,
        доступ, доступа, прав, запрос*, запит*, erişim*, izin*, istek*, åtkomst, behörighet*, begäran, adgang*, rettigheder, přístup*, oprávněn*, 访问, 訪問, 存取, 权限, 權限, 请求, 請求, アクセス, 権限, リクエスト, 접근, 접속, 권한, 요청, الوصول""",
    "entitled": "authorised, authorized, allowed, permitted, entitled, berechtigt, befugt, autorisiert, erlaubt, autorisé*, autorizad*, permitid*, autorizzat*, autorizat*, geautoriseerd, bevoegd, upoważnion*, uprawnion*, авториз*, разрешен*, yetkili*, yetkiniz, behörig, autoriseret, oprávněn*, 授权, 授權, 許可されて, 허용되",
    "lack": "lack, lacks, missing, do not have, don't have, don’t have, fehlt, fehlen, manque*, carece*, falta*, manca*, mancano, ontbreek*, brak, brakuje, saknar*, mangler, chybí, недостаточно, 缺少, 没有, 沒有, がありません, 없습니다",
    "fail": """error, failed, failure, wrong, crashed, exception, timeout, time-out, timed out, fehler, serverfehler, fehlgeschlagen, schiefgegangen, schiefgelaufen, schief, erreur, échou*, échec, falló, fallo, fallid*, errore, erro, falha*, falhou, fout, fouten, mislukt, misgegaan, błąd, błęd*, ошибк*, сбой, помилк*, збій,
        hata, hatası, fel, gick fel, fejl, chyba, chyby, 错误, 錯誤, 出错, 出錯, 失败, 失敗, エラー, 오류, 실패, خطأ, 超时, 逾時, タイムアウト""",
    "wrong": "something went wrong, went wrong, etwas ist schief*, mal passé, salió mal, andato storto, deu errado, ging er mis, ging iets mis, poszło nie tak, пошло не так, пішло не так, ters gitti, gick fel, gik galt, se pokazilo, 出了问题, 出了點問題, 問題が発生, エラーが発生, 문제가 발생",
    "busy": """too many, rate limit, rate limited, rate-limited, throttled, maintenance, upkeep, repairs, try again, try later, retry, reload, come back, overloaded, temporarily, wartung*, zu viele, überlastet, später erneut, erneut versuchen, es erneut, später noch einmal, vorübergehend, trop de, réessay*, ultérieurement, temporairement, rechargez, mantenimiento, demasiad*,
        inténtelo, inténtalo, vuelva a, vuelve a, temporalmente, manutenzione, troppe, troppi, riprova*, temporaneamente, manutenção, muitas, muitos, tente, temporariamente, onderhoud, te veel, probeer, tijdelijk, konserwac*, zbyt wiele, spróbuj*, tymczasowo, обслуживани*, слишком много, попробуйте, повторите, временно, обслуговуван*, забагато, спробуйте, тимчасово,
        bakım*, çok fazla, tekrar deneyin, geçici, underhåll, för många, försök igen, tillfälligt, vedligehold*, for mange, prøv igen, midlertidigt, údržb*, příliš mnoho, zkuste, dočasně, 维护, 維護, 过多, 過多, 太多, 稍后, 稍後, 重试, 重試, メンテナンス, 多すぎ, 後ほど, もう一度, 一時的, 점검, 너무 많, 다시 시도, 일시적""",
    "down": "is down, down for, offline, closed for, under maintenance, nicht erreichbar, außer betrieb, hors ligne, hors service, fuera de servicio, fuori servizio, fora do ar, buiten gebruik, nieczynn*, не работает, не працює, çalışmıyor, ligger nere, ligger nede, mimo provoz, 停止中, 停机, 停機, 休止中, 중단",
    "told": "been told, been notified, been informed, been alerted, been logged, benachrichtigt, informiert, été informé*, été averti*, ha sido informad*, ha sido notificad*, stato informato, stati avvisati, foi informad*, foi notificad*, op de hoogte, powiadomi*, уведомлен*, повідомлен*, bilgilendiril*, 已通知, 通知しました, 報告されました, 알림을",
    "sorry": """sorry, oops, whoops, unfortunately, apologies, apologise, apologize, entschuldig*, leider, ups, hoppla, tut uns leid, désolé*, oups, malheureusement, lo sentimos, lo siento, lamentablemente, disculp*, spiacent*, purtroppo, ci dispiace, desculp*, infelizmente, lamentamos, helaas, excuses, przepraszamy, niestety,
        извин*, к сожалению, сожалеем, вибачте, на жаль, üzgünüz, maalesef, tyvärr, ursäkta, beklager, desværre, omlouváme, bohužel, 抱歉, 对不起, 對不起, 很遗憾, 很遺憾, 申し訳, すみません, 恐れ入り, 죄송, 유감, عذرا, نأسف""",
    "script": "javascript, java script, js, script, scripts, scripting, skript*, client-side code, javascriptu, javascripta, スクリプト, 脚本, 腳本, 스크립트, 자바스크립트, скрипт*, джаваскрипт, جافا سكريبت",
    "enable": """enable, enabled, enabling, activate, activated, turn on, turned on, turn it on, switch on, switched on, switch it on, allow, allowed, allows, require, requires, required, needs, need, needed, disabled, turned off, switched off, aktivier*, einschalten, eingeschaltet, ausgeschaltet, schalten, erlauben, erlaubt, zulassen, benötig*, erforderlich, deaktiviert, activez, activer, activé*,
        autorisez, autoriser, requis, requise, nécessaire, nécessite, désactivé*, habilit*, activa, active, activar, activado, permita, permitir, necesari*, necesita, requiere, desactivad*, abilit*, attiv*, attivar*, consent*, necessari*, richiede, disabilit*, disattiv*, ative, ativ*, permita, necessário, requer, desativad*, inschakelen, ingeschakeld, schakel, nodig, vereist, uitgeschakeld, włącz*, wymaga*, wyłączon*,
        включите, включить, включен*, включён*, разреш*, необходим*, требуется, требует, отключ*, увімкн*, потріб*, вимкнен*, etkinleştir*, gerek*, devre dışı, aktivera*, aktivér*, slå på, slå til, krävs, kräver, kræver, kræves, povol*, zapn*, vyžad*, vypnut*, 启用, 啟用, 开启, 開啟, 打开, 打開, 需要, 允许, 允許, 禁用, 停用, 有効, オン, 許可, 必要, 無効, 활성화, 필요, 사용하, 허용, 비활성, تفعيل, تمكين""",
    "without": "without, ohne, sans, sin, senza, sem, zonder, bez, без, olmadan, utan, uden, 没有, 沒有, なし, 없이, بدون",
    "work": "work, works, run, runs, function, functions, loads, load, funktionier*, läuft, fonctionn*, funcion*, funzion*, werkt, działa*, работает, работать, працює, çalış*, fungera*, fungerer, virker, funguje, 运行, 運作, 工作, 動作, 動き, 작동",
    "human": "human, humans, robot, robots, bot, bots, captcha, person, program, mensch, roboter, humain*, humano*, umano, umana, robô, robotem, mens, człowiek*, человек*, робот*, людина, insan, människa, menneske, člověk, 人类, 真人, 机器人, 機器人, 人間, ロボット, 사람, 로봇",
    "verify": "verify, verifying, verification, confirm, confirms, prove, checking, opened by, requested by, bestätig*, überprüf*, prüfen, vérifi*, prouv*, confirmez, verific*, comprueb*, comprob*, demuestr*, confirme, conferm*, dimostr*, comprov*, bevestig*, controleer*, bewijs, potwierd*, sprawdz*, подтверд*, проверк*, підтверд*, doğrula*, bekräfta, bekræft*, ověř*, potvrď*, 验证, 驗證, 确认, 確認, 証明, 확인, 인증",
    "login": "sign in, log in, signed in, logged in, login, session, anmelden, einloggen, sitzung, connectez-vous, se connecter, connexion, inicia sesión, inicie sesión, iniciar sesión, sesión, accedi, sessione, faça login, iniciar sessão, sessão, inloggen, sessie, zaloguj*, sesja, войдите, войти, сесси*, увійдіть, сеанс, oturum*, giriş yap*, logga in, log ind, přihlas*, relace, 登录, 登入, 登錄, 会话, ログイン, セッション, 로그인, 세션",
    "purpose": "to continue, to view, to read, to see, to access, to open, um fortzufahren, um den, um die, pour continuer, pour voir, pour lire, para continuar, para ver, para leer, per continuare, per vedere, om door te gaan, aby kontynuować, чтобы продолжить, щоб продовжити, devam etmek, för att fortsätta, for at fortsætte, pokračov*, 继续, 繼續, 続行, 続ける, 続けて, 계속",
}
#: Sets of meanings of which a sentence must have all to be a message; in a set, a bar gives a choice, and `code` is a number of an HTTP error.
MESSAGES = [
    "script enable",
    "script without work",
    "not find thing|sorry|code|server",
    "not exist|available|open thing|sorry|code|server",
    "lost thing|sorry|code|server",
    "deny access|thing|sorry|code|server",
    "not entitled",
    "lack access",
    "fail code|sorry|server|open",
    "wrong",
    "busy server|thing|access|code|sorry|fail|wrong|down|told",
    "told sorry|fail|wrong|thing|server",
    "down server|thing|sorry|code",
    "human verify",
    "not human",
    "login lost|purpose",
]
#: Sets that make a message of a sentence that follows one in its text.
FOLLOWING = ["told", "busy"]
#: Meanings of which every message has one; only lines with a term of these are looked at.
LEADING = ["script", "find", "exist", "available", "open", "lost", "deny", "entitled", "lack", "fail", "wrong", "busy", "down", "told", "human", "login"]
_CODE = re.compile(r"(?<![\d.,])[45]\d\d(?![\d%]|[.,]\d)")
# Forms that tell a message by themselves: a status line, a trace of a program, a page that only loads.
FORMS = [
    r"\bcannot (?:get|post) /",
    r"^\W*noscript\b",
    r"^\W*(?:loading|wird geladen|chargement|cargando|caricamento|carregando|laden|ładowanie|загрузка|завантаження|yükleniyor|laddar|indlæser|načítání|加载中|載入中|読み込み中|로딩)\b.{0,80}(?:…|\.\.\.)\W*$",
    r"^\W*traceback\b|^\s*file .{1,120}, line \d+|^\W*\w*(?:error|exception)\s*:\s|\b(?:fatal|parse|syntax|runtime) error\b|\bon line \d+\s*$|\bstack trace\b|\bcore dumped\b|\bundefined (?:index|variable|offset)\b",
]
STATUS_LINE = r"^[^\w\n]*[45]\d\d[ \t]*[—–:-][ \t]+\w"
_FORMS = [re.compile(f, re.I) for f in FORMS]
_STATUS = re.compile(STATUS_LINE, re.M)
#: Of each form strings of which a match holds one, in lower case; a line without them needn't be searched.
_FORM_HINTS = ["cannot ", "noscript", "…", "...", "traceback", ", line ", "error", "exception", "on line ", "stack trace", "core dumped", "undefined "]
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n")
_BIT = {name: 1 << k for k, name in enumerate([*TERMS, "code"])}
_RULES, _MORE_RULES = ([[sum(_BIT[c] for c in part.split("|")) for part in rule.split()] for rule in rules] for rules in (MESSAGES, FOLLOWING))


def _blank(c: str) -> bool:
    """Scripts that put no blanks between words: their terms may stand anywhere."""
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯"


def _automaton(names: list[str], hints: list[str] = ()) -> ahocorasick.Automaton:
    """Finds terms; each gives its length, bits, and whether a letter may stand before and after it."""
    held: dict[str, tuple[int, int, bool, bool]] = {}
    for name in names:
        for term in TERMS[name].split(","):
            term = term.strip()
            bare = term.rstrip("*")
            free = _blank(bare[0]) or bare.startswith("n'") and term == "n't" or bare.startswith("n’") and term == "n’t"
            _, bits, before, after = held.get(bare, (0, 0, False, False))
            held[bare] = (len(bare), bits | _BIT[name], before or free, after or term.endswith("*") or _blank(bare[-1]))
    for hint in hints:
        held[hint] = (len(hint), held.get(hint, (0, 0))[1], True, True)
    out = ahocorasick.Automaton()
    for term, value in held.items():
        out.add_word(term, value)
    out.make_automaton()
    return out


class MessageFinder:
    """Finds the lines of a text that hold a message."""

    def __init__(self) -> None:
        self.leading = _automaton(LEADING, _FORM_HINTS)
        self.all = _automaton(list(TERMS))
        self._told: dict[int, tuple[bool, bool]] = {}  # what sets of meanings make

    def _bits(self, low: str) -> int:
        found, n = 0, len(low)
        for end, (length, bits, before, after) in self.all.iter(low):
            start = end - length
            if (before or start < 0 or not low[start].isalnum()) and (after or end + 1 >= n or not low[end + 1].isalnum()):
                found |= bits
        return found | _BIT["code"] if ("4" in low or "5" in low) and _CODE.search(low) else found

    def is_message(self, sentence: str, following: bool = False) -> bool:
        bits = self._bits(sentence.lower())
        told = self._told.get(bits)
        if told is None:
            told = self._told[bits] = tuple(any(all(bits & part for part in rule) for rule in rules) for rules in (_RULES, _MORE_RULES))
        return told[0] or following and told[1]

    def sentences(self, line: str, following: bool = False) -> tuple[bool, list[str], list[str]]:
        """Whether the line holds a message, and its sentences that hold none: those before the first message, and those after."""
        low = line.lower()
        if any(h in low for h in _FORM_HINTS) and any(f.search(line) for f in _FORMS) or _STATUS.match(line):
            return True, [], []
        before, after, hit = [], [], False
        for sentence in _SENTENCE.split(line):
            if self.is_message(sentence, following or hit):
                hit = True
            elif sentence.strip():
                (after if hit else before).append(sentence)
        return hit, before, after

    def lines(self, text: str) -> Iterator[tuple[int, str, list[str], list[str]]]:
        """(line number, line, its sentences before a message and its other ones without) of the lines with one."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would shift all places
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        # where a term or a status line stands
        places = [end for end, (length, _, before, after) in self.leading.iter(low) if (before or end < length or not low[end - length].isalnum()) and (after or end + 1 >= len(low) or not low[end + 1].isalnum())]
        status = [m.end() - 1 for m in _STATUS.finditer(low)]
        if status:
            places = sorted(places + status)
        at, line_no, begin, following = -1, 0, 0, False
        for end in places:
            if end <= at:
                continue
            begin_of = low.rfind("\n", 0, end) + 1
            line_no += low.count("\n", begin, begin_of)
            begin = begin_of
            at = low.find("\n", end)
            at = len(low) if at < 0 else at
            hit, *rest = self.sentences(text[begin:at], following)
            if hit:
                following = True
                yield line_no, text[begin:at], *rest
