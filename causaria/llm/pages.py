"""Made-up pages of many layouts with their main text, for training the block labeller.

What a page is made of is drawn: the parts it has and their order, the elements
that hold them, how those are named (by what they hold, in one of several
styles, or by nothing that tells), and the words: of four languages, or made up
of syllables.
"""

from __future__ import annotations

import numpy as np

#: Words that texts of any kind have.
COMMON = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one were all we when there been if more when will would who so no "
    "der die und in den von zu das mit sich des auf ist nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec elle aux cette ou mais nous "
    "el los que y en del se las por un para con no una su al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre"
).split()
#: Words of articles, to go between those.
TOPICS = "river council engine winter teacher market bridge study village paper music village science harvest player border patient museum lawyer coach theory court island budget recipe garlic session history weather mountain soldier planet factory farmer novel voter minister protein signal desert railway".split()
#: What menus, notices and the like say.
MENU = "Home|News|Sport|World|Business|About us|Contact|Blog|Shop|Products|Services|Support|Login|Sign in|Register|My account|Search|Politics|Culture|Opinion|Video|Photos|Archive|Events|Careers|Help|FAQ|Docs|Download|Startseite|Kontakt|Über uns|Accueil|Actualités|Inicio|Noticias|Next|Previous|Older posts|Categories|Tags|Sitemap|RSS|English|Deutsch|Français|Español|Forum|Gallery|Pricing|Cart".split("|")
FOOT = "All rights reserved|Privacy policy|Terms of use|Cookie settings|Imprint|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by WordPress|Follow us on Twitter|Facebook|Instagram|Back to top|Contact us|Accessibility|Advertise with us".split("|")
NOTICE = "We use cookies to improve your experience on our site.|By using this website you agree to our use of cookies.|Accept all|Reject|Manage preferences|Subscribe to our newsletter|Enter your email address|Sign up now and never miss a story|Wir verwenden Cookies|Ce site utilise des cookies|Este sitio utiliza cookies|Please enable JavaScript to view this page.|You have 2 free articles left this month.|Unlimited access from 1 euro a week|Get the best of our stories in your inbox every morning.".split("|")
ADS = "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now and save 50 percent|Limited offer: free shipping on all orders|Shop the sale today|The best credit cards of the year|Lose weight fast with this one trick|Click here|Learn more|Promoted content|Great deals on flights and hotels".split("|")
SHARE = "Share|Tweet|Share on Facebook|Email this|Print|Copy link|Pin it|WhatsApp|Save|Like|Follow|Teilen|Partager|Compartir".split("|")
RELATED = "Related articles|Read more|Most popular|You may also like|Recommended for you|Trending now|More from this section|Latest news|Lesen Sie auch|À lire aussi|Le puede interesar|See also|Popular posts|Recent posts|Recent comments".split("|")
COMMENT = "Reply|Report|Log in to comment|Leave a reply|3 comments|Comments|Kommentare|Commentaires|Comentarios|Great post, thanks for sharing!|I totally agree with you|lol this is so true|Thanks, very helpful|This is wrong in so many ways.|says:|wrote:|2 days ago|Like|First!|Can you explain the second step?|Join the discussion|Show more comments|Your email address will not be published.".split("|")
BYLINE = "By {}|by {} on May 4, 2021|{}, 12 March 2019|Published 3 June 2020|Posted by {}|Von {}|Par {}|Por {}|Updated 09:41 GMT|Photo: {}|5 min read".split("|")

#: What names of holders are made of, by what they hold.
NAMES = {
    "main": "article post entry story content body text main page news blog single copy prose richtext detail hentry markdown document reading",
    "head": "header masthead top logo brand site banner hero topbar branding",
    "menu": "nav menu navbar navigation links topnav subnav breadcrumb breadcrumbs tabs toc pagination pager categories mainmenu",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo dfp adslot slot gpt banner taboola outbrain commercial partner adsense",
    "side": "sidebar aside widget rail secondary col related recommended popular trending more teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter signup subscribe subscription paywall message optin",
    "share": "share sharing social tools toolbar sharebar buttons actions sharedaddy addthis",
    "comments": "comment comments reply replies respond discussion disqus thread responses feedback commentlist reader",
    "foot": "footer foot bottom copyright legal colophon siteinfo credits",
    "form": "form search login contact subscribe searchform poll",
    "box": "wrapper container inner outer box block area section row grid layout wrap column group flex item list site app root",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
PREFIXES = "td c js wp mw m l o site page tpl et elementor block uk art cms node view field".split()


class Maker:
    """One page at a time; kept is the main text's blocks in order."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.kept: list[str] = []
        self.plain = self.maybe(0.25)  # names that tell nothing
        self.junk = self.pick(" |", "###", "%%%", "***", " *", " &amp;", "$$$", "!!!", " /", " -") if self.maybe(0.12) else ""
        self.made = self.maybe(0.4)  # words made up of syllables
        self.few = [self.gibberish() if self.maybe(0.5) else self.pick(*TOPICS) for _ in range(4)]

    def maybe(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, *xs):
        return xs[int(self.rng.integers(len(xs)))]

    def n(self, lo: int, hi: int) -> int:
        return int(self.rng.integers(lo, hi))

    def gibberish(self) -> str:
        return "".join(self.rng.choice([*"abcdefghijklmnopqrstuvwxyz0123456789"], self.n(4, 8)))

    # Words

    def word(self) -> str:
        if self.maybe(0.45):
            return self.pick(*COMMON)
        if self.made or self.maybe(0.5):
            return "".join(self.pick("th", "er", "on", "an", "re", "st", "ment", "ción", "ung", "lich", "é", "tion", "ou", "sch", "ar", "mo", "ka", "li", "eux", "ing") for _ in range(self.n(1, 4)))
        return self.pick(*TOPICS)

    def words(self, lo: int, hi: int) -> str:
        if self.junk and self.maybe(0.7):  # text as spoiled as some pages' is
            return " ".join(self.word() + (self.junk if self.maybe(0.5) else "") for _ in range(self.n(lo, hi)))
        some = [self.word() + ("," if self.maybe(0.05) else "") for _ in range(self.n(lo, hi))]
        if self.maybe(0.01):
            some += [some[-1]] * self.n(2, 12)
        if self.maybe(0.1):
            some[self.n(0, len(some))] = self.number()
        return " ".join(some)

    def number(self) -> str:
        return self.pick("{}", "{},{:03d}", "{}.{}", "{} %", "1{:02d}{}", "{} kg").format(self.n(1, 99), self.n(0, 999))

    def sentence(self) -> str:
        x = self.words(self.pick(1, 3, 3), self.pick(6, 18, 30))
        return x[:1].upper() + x[1:].rstrip(",") + self.pick(".", ".", ".", ".", "!", "?", ":")

    def prose(self, lo: int = 1, hi: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.n(lo, hi)))

    def item(self) -> str:
        return self.pick(f"{self.number()} {self.words(1, 3)}", self.words(1, 4), self.number())

    def title(self) -> str:
        x = self.words(2, 12)
        return (x[:1].upper() + x[1:]).rstrip(",") + self.pick("", "", "", "", ".", "?")

    def name(self) -> str:
        return " ".join(self.pick("Anna", "John", "Maria", "Peter", "Lucía", "Jean", "Mike", "Sofie") for _ in range(1)) + " " + self.pick("Berg", "Smith", "Rossi", "Dubois", "Kim", "García", "Novak", "Jones")

    def phrase(self, of: list[str]) -> str:
        return self.pick(*of).format(self.name())

    # Elements

    def attrs(self, kind: str, sure: float = 0.0) -> str:
        """class, id or role as some site might name what it holds; sure: how seldom it is left out."""
        if self.plain and (kind in ("main", "box", "side") or self.maybe(0.5)) or self.maybe(0.08 * (1 - sure)):
            return self.pick("", "", f' class="{self.pick(*self.few)}"', f' class="css-{self.gibberish()}"', f' id="{self.pick(*self.few)}"')
        parts = [self.pick(*NAMES[kind])]
        if self.maybe(0.35):
            parts.insert(self.pick(0, 1), self.pick(*NAMES["box"]))
        elif self.maybe(0.2):
            parts.append(self.pick(*NAMES[kind]))
        if self.maybe(0.2):
            parts.insert(0, self.pick(*PREFIXES))
        style = self.n(0, 5)
        made = "-".join(parts) if style < 2 else "_".join(parts) if style == 2 else "".join(p.title() for p in parts) if style == 3 else parts[0] + "".join(p.title() for p in parts[1:])
        if self.maybe(0.1):
            made += self.pick("--large", "__inner", f"-{self.n(1, 99)}", " clearfix", f" {self.gibberish()}")
        return f' {self.pick("class", "class", "class", "id")}="{made}"' + (f' style="color:{self.gibberish()}"' if self.maybe(0.05) else "")

    def holder(self, tags: str, kind: str, inner: str, sure: float = 0.0) -> str:
        tag = self.pick(*tags.split())
        named = tag in ("nav", "header", "footer", "aside", "article", "main", "form")
        attrs = "" if named and self.maybe(0.5) else self.attrs(kind, 0.0 if named else sure)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def boxed(self, inner: str, most: int) -> str:
        for _ in range(self.n(0, most + 1)):
            inner = f"<div{self.attrs('box') if self.maybe(0.8) else ''}>{inner}</div>"
        return inner

    def link(self, text: str) -> str:
        return f'<a href="/{self.gibberish()}">{text}</a>'

    def links(self, of: list[str], lo: int, hi: int) -> str:
        one = lambda: self.link(self.phrase(of) if self.maybe(0.6) else self.title() if self.maybe(0.3) else self.words(1, 3))
        some = [one() for _ in range(self.n(lo, hi))]
        style = self.n(0, 4)
        if style < 2:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>"
        return self.pick(" | ", " ", " &middot; ", " &raquo; ").join(some) if style == 2 else "".join(f"<div>{x}</div>" for x in some)

    # Parts that aren't main text

    def menu(self) -> str:
        return self.holder("nav nav div div ul", "menu", self.links(MENU, 2, 9), 0.5)

    def head(self) -> str:
        inside = [self.pick("<h1>{}</h1>", "<p>{}</p>", '<a href="/">{}</a>', "<div>{}</div>", "<h2>{}</h2>").format(self.words(1, 4).title())]
        if self.maybe(0.4):
            inside.append(f"<p>{self.title()}</p>")
        if self.maybe(0.5):
            inside.append(self.menu())
        if self.maybe(0.2):
            inside.append(self.form())
        return self.holder("header header div", "head", "".join(inside), 0.9)

    def form(self) -> str:
        return self.holder("form form div", "form", f'{self.pick("", "<label>" + self.phrase(MENU) + "</label>", "<p>" + self.sentence() + "</p>")}<input name="q"><button>{self.pick("Search", "Send", "Go", "OK", "Submit", "Vote")}</button>', 1.0) if self.maybe(0.5) else f'<form action="/{self.gibberish()}"><label>{self.words(1, 4)}</label><input name="q"><select><option>{self.word()}</option></select><button>{self.word()}</button></form>'

    def ad(self) -> str:
        inside = self.pick(self.phrase(ADS), self.phrase(ADS), self.prose(1, 3), self.link(self.phrase(ADS)), f"<p>{self.phrase(ADS)}</p><p>{self.prose(1, 2)}</p>", f"<h4>{self.title()}</h4>{self.link(self.phrase(ADS))}")
        return self.holder("div div div aside section ins", "ad", inside, 1.0)

    def notice(self) -> str:
        inside = f"{self.pick('<p>{}</p>', '{}', '<div>{}</div>', '<h4>{}</h4>').format(self.phrase(NOTICE) if self.maybe(0.8) else self.prose(1, 3))}{self.pick('', f'<button>{self.phrase(NOTICE)}</button>', self.link(self.phrase(NOTICE)))}"
        return self.holder("div div div section aside", "notice", inside, 0.9)

    def share(self) -> str:
        return self.holder("div div ul", "share", self.links(SHARE, 2, 6), 0.7)

    def related(self) -> str:
        inside = f"<h3>{self.phrase(RELATED)}</h3>" if self.maybe(0.8) else ""
        inside += self.links([self.title() for _ in range(4)], 2, 7) if self.maybe(0.7) else "".join(f"<div><h4>{self.link(self.title())}</h4><p>{self.prose(1, 2)}</p></div>" for _ in range(self.n(1, 4)))
        return self.holder("aside div div section", "side", inside, 0.8)

    def side(self) -> str:
        return self.holder("aside aside div div", "side", "".join(self.pick(self.related, self.ad, self.form, self.notice, lambda: f"<h3>{self.phrase(RELATED)}</h3><p>{self.prose(1, 3)}</p>")() for _ in range(self.n(1, 4))), 1.0)

    def comments(self) -> str:
        said = lambda: self.pick(f"<p>{self.prose(1, 4)}</p>", f"<p>{self.phrase(COMMENT)}</p>", f"<div>{self.prose(1, 3)}</div>")
        by = lambda: self.pick(f"<b>{self.name()}</b> {self.phrase(COMMENT)}", f"<div>{self.name()}</div><span>2 days ago</span>", f"<cite>{self.name()}</cite>", "")
        one = lambda: f"<{(t := self.pick('li', 'div', 'div', 'article'))}{self.attrs('comments', 0.5) if self.maybe(0.7) else ''}>{by()}{said()}{self.link(self.phrase(COMMENT)) if self.maybe(0.4) else ''}</{t}>"
        inside = (f"<h3>{self.phrase(COMMENT)}</h3>" if self.maybe(0.8) else "") + "".join(one() for _ in range(self.n(1, 6))) + (self.form() if self.maybe(0.3) else "")
        return self.holder("div div section ol", "comments", inside, 1.0)

    def foot(self) -> str:
        text = self.pick("&copy; {} {}", "Copyright 2021 {}. {}", "{} &middot; {}", "&copy; 2019 {} &middot; {}.").format(self.words(1, 4), self.phrase(FOOT) if self.maybe(0.6) else self.prose(1, 4))
        inside = self.pick("<p>{}</p>", "{}", "<div>{}</div>").format(text)
        if self.maybe(0.5):
            inside = self.links(FOOT, 2, 7) + inside
        return self.holder("footer footer div", "foot", inside, 0.8)

    # Main text

    def keep(self, text: str) -> str:
        self.kept.append(" ".join(text.split(" ")))
        return text

    def inline(self, text: str) -> str:
        """text with some of its words marked up: the block's text stays."""
        ws = text.split(" ")
        if len(ws) > 3 and self.maybe(0.4):
            for _ in range(self.n(1, 4)):
                k = self.n(0, len(ws))
                if "<" not in ws[k]:
                    ws[k] = self.pick("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", '<a href="http://h/y" rel="nofollow">{}</a>').format(ws[k])
        return " ".join(ws)

    def paragraph(self) -> str:
        text = self.keep(self.prose(1, self.pick(2, 2, 4, 8)) if self.maybe(0.92) else self.words(1, 6))
        style = self.n(0, 12)
        if style == 0:
            return f"<p><b>{text}<br>"
        if style == 1:
            return f"<p>{self.inline(text)}"
        return f"<p{self.pick('', '', '', self.attrs('main'), ' class=intro')}>{self.inline(text)}</p>"

    def body(self, noisy: float) -> str:
        out = []
        loose = self.maybe(0.06)  # paragraphs of div
        for _ in range(self.n(1, self.pick(4, 10, 16, 16, 16, 45))):
            k = self.rng.random()
            if k < 0.66:
                out.append(f"<div>{self.inline(self.keep(self.prose()))}</div>" if loose else self.paragraph())
            elif k < 0.75:
                t = self.pick("h2", "h2", "h3", "h4")
                out.append(f"<{t}>{self.keep(self.title())}</{t}>")
            elif k < 0.82:
                t = self.pick("ul", "ol")
                out.append(f"<{t}>" + "".join(f"<li>{self.inline(self.keep(self.pick(self.title, self.sentence, self.prose, self.item)()))}</li>" for _ in range(self.n(1, 6))) + f"</{t}>")
            elif k < 0.86:
                out.append(f"<blockquote>{self.pick('<p>{}</p>', '{}').format(self.keep(self.prose(1, 3)))}</blockquote>")
            elif k < 0.88:
                out.append(f"<pre>{self.keep(self.words(3, 20))}</pre>")
            elif k < 0.905:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.item())}</td>" for _ in range(self.n(2, 4))) + "</tr>" for _ in range(self.n(1, 4))) + "</table>")
            elif k < 0.93:
                out.append(f'<figure><img src="x.jpg"><figcaption>{self.keep(self.sentence())}</figcaption></figure>')
            if self.maybe(noisy):
                out.append(self.pick(self.ad, self.ad, self.related, self.notice, self.share, self.form, lambda: "<script>var a=1;</script><style>p{margin:0}</style>")())
        return "".join(out)

    def article(self) -> str:
        top = []
        if self.maybe(0.92):
            t = self.pick("h1", "h1", "h1", "h1", "h2")
            top.append(f"<{t}{self.attrs('main') if self.maybe(0.3) else ''}>{self.keep(self.title())}</{t}>")
        if self.maybe(0.25):
            top.append(self.pick("<p>{}</p>", '<div class="byline">{}</div>', '<p class="author">{}</p>', "<time>{}</time>", '<span class="date">{}</span>').format(self.keep(self.phrase(BYLINE))))
            if top[-1].startswith(("<time", "<span")):
                top.append("<hr>")
        head = "".join(top)
        if self.maybe(0.12):
            head = f"<header>{head}</header>"
        share = self.share() if self.maybe(0.15) else ""
        inner = head + share + self.boxed(self.body(self.pick(0, 0, 0.05, 0.15)), 1) + (self.share() if self.maybe(0.15) else "")
        if self.maybe(0.1):
            inner += self.related()
        if self.maybe(0.12):
            inner += self.comments()
        return inner

    def page(self) -> tuple[str, list[str]]:
        if self.maybe(0.04):
            return f"<html><body>{self.boxed(self.article(), 1)}</body></html>", self.kept
        noise = lambda p, *made: "".join(self.pick(*made)() for _ in range(self.n(1, 3))) if self.maybe(p) else ""
        top = "".join(x for x in (noise(0.15, self.notice), self.head() if self.maybe(0.6) else "", self.menu() if self.maybe(0.75) else "", f"<!-- {self.word()} -->" if self.maybe(0.3) else "", noise(0.4, self.ad, self.ad, self.notice, self.form, self.share)))
        before = self.side() if self.maybe(0.12) else ""
        if self.maybe(0.02):
            text = ""
        else:
            text = self.article()
            kind = self.n(0, 12)
            if kind < 3:
                text = f"<article{self.attrs('main') if self.maybe(0.4) else ''}>{text}</article>"
            elif kind < 4:
                text = f"<main>{text}</main>"
            elif kind < 5:
                text = f"<main><article>{text}</article></main>"
            elif kind < 10:
                text = self.holder("div div div section", "main", text, 0.6)
            elif kind < 11:
                text = f"<table><tr><td{self.pick('', self.attrs('main'))}>{text}</td></tr></table>"
            text = self.boxed(text, 3)
        after = noise(0.35, self.comments, self.comments, self.related, self.ad) + (self.side() if self.maybe(0.25) else "") + noise(0.15, self.notice, self.share, self.form)
        middle = self.boxed(before + text + after, 2)
        bottom = self.foot() if self.maybe(0.9) else ""
        bottom += self.notice() if self.maybe(0.08) else ""
        start = f"<!DOCTYPE html><html><head><title>{self.title()}</title><style>p{{margin:0}}</style></head><body{self.attrs('box') if self.maybe(0.2) else ''}>"
        return start + top + middle + bottom + ("</body></html>" if self.maybe(0.9) else ""), self.kept


def sample_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made-up page and its main text's blocks, in order."""
    return Maker(rng).page()
