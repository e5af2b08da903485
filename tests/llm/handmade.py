"""Pages written by hand after real layouts, none of them of the maker's, with their main text: (name, html, blocks)."""

HEAD = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><script>var x = '<p>';</script></head>"
P1 = "The council voted on Tuesday to close the old bridge for the whole of next year, after engineers found cracks in two of its piers."
P2 = "Residents on the east bank say that they were not asked. “We heard about it on the radio,” said one of them, who has run a bakery there since 1998."
P3 = "A ferry will cross every twenty minutes, and buses are to be free of charge until the work is done."
P4 = "It is not the first time that the river has divided the town: in 1921 the bridge was washed away by a flood."
H = "Old bridge to close for a year"

PAGES = [
    ("judge: story", f'{HEAD}<body><div class="masthead"><a href="/">The Herald</a></div><ul class="topnav"><li><a href="/a">News</a><li><a href="/b">Sport</a></ul><div class="story"><h1>{H}</h1><p>{P1}</p><p>{P2}</p></div><div class="footer">© The Herald</div></body></html>', [H, P1, P2]),
    ("judge: td-post-content", f'{HEAD}<body><div class="td-header-wrap"><a href="/">Site</a></div><div class="td-post-content"><h1>{H}</h1><p>{P1}</p><p>{P3}</p></div><div class="comments" id="comments"><h4>2 COMMENTS</h4><div class="comment"><p>I have crossed that bridge every day for ten years and it never moved.</p></div><div class="comment"><p>About time too.</p></div></div></body></html>', [H, P1, P3]),
    ("judge: dfp-slot", f'{HEAD}<body><nav><a href="/">Home</a></nav><article><h1>{H}</h1><p>{P1}</p><div class="dfp-slot">Advertisement</div><p>{P2}</p></article></body></html>', [H, P1, P2]),
    ("blog with widgets", f'{HEAD}<body class="home blog"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My garden</a></p><p class="site-description">Notes from a small plot</p></header><nav id="site-navigation" class="main-navigation"><ul id="menu-main"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></nav><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-12" class="post-12 post type-post"><header class="entry-header"><h1 class="entry-title">Sowing beans in May</h1></header><div class="entry-content"><p>Beans want warm soil, so I wait until the hawthorn is in flower.</p><p>Put two seeds in each hole and take out the weaker plant later.</p><h2>What you need</h2><ul><li>A packet of seeds</li><li>Eight poles, two metres long</li></ul></div></article></main></div><aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/1">Pruning roses</a></li><li><a href="/2">The first frost</a></li></ul></section></aside><footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by WordPress</div></footer></div></body></html>', ["Sowing beans in May", "Beans want warm soil, so I wait until the hawthorn is in flower.", "Put two seeds in each hole and take out the weaker plant later.", "What you need", "A packet of seeds", "Eight poles, two metres long"]),
    ("hashed classes", f'{HEAD}<body><div id="root"><div class="sc-a1b2c3"><a class="sc-x9" href="/">Daily</a><a class="sc-x9" href="/w">World</a><a class="sc-x9" href="/s">Science</a></div><div class="sc-d4e5"><div class="sc-f6"><h1 class="sc-t1">{H}</h1><p class="sc-p0">{P1}</p><p class="sc-p0">{P2}</p><p class="sc-p0">{P3}</p></div></div><div class="sc-z9"><span>© 2022 Daily Ltd. All rights reserved.</span> <a href="/p">Privacy policy</a></div></div></body></html>', [H, P1, P2, P3]),
    ("table layout of the nineties", f'<html><head><title>x</title></head><body bgcolor=white><table width=100%><tr><td colspan=2><font size=5>Town Gazette</font></td></tr><tr><td width=120 valign=top><a href=index.html>Home</a><br><a href=news.html>News</a><br><a href=links.html>Links</a></td><td valign=top><h1>{H}</h1><p>{P1}<p>{P2}<p>{P4}</td></tr></table><hr><center><small>Copyright 1999 Town Gazette</small></center></body></html>', [H, P1, P2, P4]),
    ("bare", f"<html><body><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></body></html>", [H, P1, P2, P3]),
    ("encyclopedia", f'{HEAD}<body class="mediawiki"><div id="mw-navigation"><h2>Navigation menu</h2><div id="p-personal" role="navigation"><ul><li><a href="/c">Create account</a></li><li><a href="/l">Log in</a></li></ul></div></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading" class="firstHeading">Stone bridge</h1><div id="bodyContent"><div id="mw-content-text"><p>A <b>stone bridge</b> is a <a href="/w">bridge</a> whose arches are built of <a href="/s">stone</a>.</p><h2>History</h2><p>The oldest that still carry traffic were built by the Romans, some two thousand years ago.</p><ul><li>Alcántara, built in 106</li><li>Rimini, finished in 21</li></ul></div></div></div><div id="footer" role="contentinfo"><ul><li>This page was last edited on 3 May 2021.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>', ["Stone bridge", "A stone bridge is a bridge whose arches are built of stone.", "History", "The oldest that still carry traffic were built by the Romans, some two thousand years ago.", "Alcántara, built in 106", "Rimini, finished in 21"]),
    ("cookie banner first", f'{HEAD}<body><div id="CybotCookiebotDialog" role="dialog"><p>This website uses cookies. We use them to personalise content and ads and to analyse our traffic.</p><button>Allow all</button></div><main><h1>{H}</h1><p>{P1}</p><p>{P3}</p></main></body></html>', [H, P1, P3]),
    ("newsletter box in the text", f'{HEAD}<body><main class="article-page"><h1>{H}</h1><p>{P1}</p><div class="newsletter-signup"><h3>Never miss a story</h3><p>Get our best stories in your inbox every morning.</p><form><input type=email><button>Subscribe</button></form></div><p>{P2}</p><p>{P4}</p></main></body></html>', [H, P1, P2, P4]),
    ("related links in the text", f'{HEAD}<body><article><h1>{H}</h1><p>{P1}</p><aside class="related-inline"><strong>Read more:</strong> <a href="/r">Which other bridges are at risk?</a></aside><p>{P3}</p></article></body></html>', [H, P1, P3]),
    ("share bars", f'{HEAD}<body><div class="post"><h1>{H}</h1><div class="sharedaddy"><ul><li><a href="#">Click to share on Twitter</a></li><li><a href="#">Facebook</a></li></ul></div><p>{P1}</p><p>{P2}</p><div class="social-share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div></div></body></html>', [H, P1, P2]),
    ("disqus", f'{HEAD}<body><article class="h-entry"><h1 class="p-name">{H}</h1><div class="e-content"><p>{P1}</p><p>{P4}</p></div></article><section id="disqus_thread"><h2>Join the discussion</h2><ul><li><cite>Ann</cite><p>My grandfather told me about the flood, he was ten years old then.</p></li><li><cite>Bob</cite><p>Same here!</p></li></ul></section></body></html>', [H, P1, P4]),
    ("comment list of a blog", f'{HEAD}<body><div id="wrapper"><div class="hentry"><h2 class="post-title">{H}</h2><div class="post-body"><p>{P1}</p><p>{P2}</p></div></div><div id="comments"><h3 id="comments-title">One response</h3><ol class="commentlist"><li><div class="comment-author"><cite>Jim</cite> says:</div><p>Thank you for writing this, I had no idea that it was that bad.</p><a class="comment-reply-link" href="#">Reply</a></li></ol><div id="respond"><h3>Leave a Reply</h3><p>Your email address will not be published.</p></div></div></div></body></html>', [H, P1, P2]),
    ("German news", f'{HEAD}<body><header class="kopf"><a href="/">Tagblatt</a><nav class="hauptmenue"><ul><li><a href="/p">Politik</a></li><li><a href="/w">Wirtschaft</a></li></ul></nav></header><main><article><h1>Alte Brücke wird gesperrt</h1><p>Der Rat hat am Dienstag beschlossen, die alte Brücke für ein ganzes Jahr zu sperren.</p><p>Die Anwohner sind verärgert, weil niemand mit ihnen gesprochen hat.</p></article><div class="anzeige">Anzeige</div></main><footer><a href="/i">Impressum</a> <a href="/d">Datenschutz</a></footer></body></html>', ["Alte Brücke wird gesperrt", "Der Rat hat am Dienstag beschlossen, die alte Brücke für ein ganzes Jahr zu sperren.", "Die Anwohner sind verärgert, weil niemand mit ihnen gesprochen hat."]),
    ("French blog", f'{HEAD}<body><div id="bandeau">Mon carnet</div><div id="contenu"><h1>Le vieux pont</h1><p>Le conseil a décidé de fermer le vieux pont pendant toute une année.</p><p>Les habitants de la rive droite ne sont pas contents, et ils ont raison.</p></div><div id="pied">Tous droits réservés</div></body></html>', ["Le vieux pont", "Le conseil a décidé de fermer le vieux pont pendant toute une année.", "Les habitants de la rive droite ne sont pas contents, et ils ont raison."]),
    ("Spanish with side column", f'{HEAD}<body><div class="cabecera"><ul><li><a href="/">Portada</a></li><li><a href="/d">Deportes</a></li></ul></div><div class="contenido"><h1>El puente viejo cierra</h1><p>El ayuntamiento ha decidido cerrar el puente durante un año para repararlo.</p><p>Los vecinos se quejan de que nadie les preguntó.</p></div><div class="sidebar"><h3>Lo más leído</h3><ol><li><a href="/1">Sube el precio del pan</a></li><li><a href="/2">Lluvia el fin de semana</a></li></ol></div></body></html>', ["El puente viejo cierra", "El ayuntamiento ha decidido cerrar el puente durante un año para repararlo.", "Los vecinos se quejan de que nadie les preguntó."]),
    ("documentation", f'{HEAD}<body><div class="sphinxsidebar"><h3>Table of Contents</h3><ul><li><a href="#a">Install</a></li><li><a href="#b">Usage</a></li></ul></div><div class="document"><div class="body" role="main"><h1>Install</h1><p>Unpack the archive and run the script in its folder.</p><pre>./configure && make</pre><p>If that fails, see the log.</p></div></div><div class="footer">© Copyright 2020, The authors.</div></body></html>', ["Install", "Unpack the archive and run the script in its folder.", "./configure && make", "If that fails, see the log."]),
    ("recipe", f'{HEAD}<body><nav class="breadcrumbs"><a href="/">Home</a> › <a href="/s">Soups</a></nav><div class="recipe"><h1>Leek soup</h1><p>A soup for cold days, ready in half an hour.</p><h2>Ingredients</h2><ul><li>3 leeks</li><li>500 g potatoes</li><li>1 l stock</li></ul><h2>Method</h2><ol><li>Cut the leeks and wash them well.</li><li>Boil everything for twenty minutes, then blend it.</li></ol></div><div class="ad-container"><div id="google_ads_1">Advertisement</div></div></body></html>', ["Leek soup", "A soup for cold days, ready in half an hour.", "Ingredients", "3 leeks", "500 g potatoes", "1 l stock", "Method", "Cut the leeks and wash them well.", "Boil everything for twenty minutes, then blend it."]),
    ("data table", f'{HEAD}<body><article><h1>Traffic on the bridge</h1><p>The count was made in the first week of May.</p><table><tr><th>Day</th><th>Cars</th></tr><tr><td>Monday</td><td>4,120</td></tr><tr><td>Tuesday</td><td>3,980</td></tr></table><p>On Sunday the bridge was closed.</p></article><footer><p>Contact: info@example.org</p></footer></body></html>', ["Traffic on the bridge", "The count was made in the first week of May.", "Day", "Cars", "Monday", "4,120", "Tuesday", "3,980", "On Sunday the bridge was closed."]),
    ("quote and caption", f'{HEAD}<body><div class="layout"><div class="article__body"><h1>{H}</h1><figure><img src=b.jpg alt=""><figcaption>The bridge in the flood of 1921.</figcaption></figure><p>{P1}</p><blockquote><p>We heard about it on the radio.</p></blockquote><p>{P3}</p></div></div><div class="l-footer"><p>All rights reserved.</p></div></body></html>', [H, "The bridge in the flood of 1921.", P1, "We heard about it on the radio.", P3]),
    ("paragraphs as divs", f'{HEAD}<body><div class="nav-bar"><a href="/">Home</a> <a href="/x">Archive</a></div><div class="text"><h1>{H}</h1><div>{P1}</div><div>{P2}</div><div>{P4}</div></div><div class="bottom">© 2011</div></body></html>', [H, P1, P2, P4]),
    ("one long paragraph with breaks", f'{HEAD}<body><div id="menu"><a href="/">Home</a></div><div id="content"><h1>{H}</h1><p>{P1}<br><br>{P2}<br><br>{P3}</p></div></body></html>', [H, f"{P1} {P2} {P3}"]),
    ("unclosed and upper case", f"<HTML><BODY><TABLE><TR><TD><UL><LI><A HREF=a>Start</A><LI><A HREF=b>Gallery</A></UL></TD></TR></TABLE><DIV ID=main><H1>{H}</H1><P>{P1}<P>{P3}<P>{P4}</DIV><DIV ID=foot>Last change: 4.5.2003</DIV></BODY>", [H, P1, P3, P4]),
    ("entities", f'{HEAD}<body><header><b>Site</b></header><article><h1>Fish &amp; chips &ndash; a history</h1><p>It cost 2&nbsp;pence in 1860 &#8212; or so they&rsquo;d have us believe; today it is &euro;12.</p></article></body></html>', ["Fish & chips – a history", "It cost 2\xa0pence in 1860 — or so they’d have us believe; today it is €12."]),
    ("poll and search", f'{HEAD}<body><form class="search"><label>Search this site</label><input name=q></form><div class="entry"><h1>{H}</h1><p>{P1}</p><p>{P2}</p></div><form id="poll"><p>Should the bridge be closed?</p><label><input type=radio>Yes</label> <label><input type=radio>No</label><button>Vote</button></form></body></html>', [H, P1, P2]),
    ("sponsored teaser after the text", f'{HEAD}<body><article><h1>{H}</h1><p>{P1}</p><p>{P3}</p></article><div class="taboola-container"><h3>You May Also Like</h3><div><a href="/z">Doctors hate this trick: lose weight while you sleep</a><span>Sponsored</span></div><div><a href="/y">The ten best cars of the year</a><span>Promoted</span></div></div></body></html>', [H, P1, P3]),
    ("sidebar before the text", f'{HEAD}<body><div class="left-col"><h4>Sections</h4><ul><li><a href="/a">Local</a></li><li><a href="/b">Region</a></li></ul><div class="promo"><p>Support local news for 2 euros a month.</p></div></div><div class="center-col"><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P4}</p></div></body></html>', [H, P1, P2, P4]),
    ("forum notice and paywall", f'{HEAD}<body><div class="site-notice">Please enable JavaScript to use this site.</div><section class="content__article-body"><h1>{H}</h1><p>{P1}</p><p>{P3}</p></section><div class="paywall-overlay"><h2>Subscribe to read on</h2><p>Unlimited access from 1 euro a week.</p></div></body></html>', [H, P1, P3]),
    ("byline and date", f'{HEAD}<body><header class="site-header"><a href="/">Courier</a></header><main><article><h1>{H}</h1><p class="byline">By Ellen Park</p><p>{P1}</p><p>{P2}</p></article></main><footer class="site-footer"><p>© Courier Media</p></footer></body></html>', [H, "By Ellen Park", P1, P2]),
    ("nothing but a menu", f'{HEAD}<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Contact</a></li></ul></nav><footer>© 2020 Nobody</footer></body></html>', []),
    ("newspaper grid", f'{HEAD}<body><div class="u-grid"><div class="c-topbar"><a href="/s">Subscribe</a><a href="/l">Log in</a></div><div class="c-article-layout"><div class="c-article-layout__main"><h1 class="c-headline">{H}</h1><div class="c-standfirst">Ferry and free buses to replace it.</div><div class="c-richtext"><p>{P1}</p><p>{P2}</p><div class="c-ad c-ad--mpu"><span>Advertisement</span></div><p>{P3}</p></div></div><div class="c-article-layout__rail"><div class="c-most-read"><h3>Most read</h3><ol><li><a href="/1">Storm on the way</a></li><li><a href="/2">School to open in May</a></li></ol></div></div></div><div class="c-site-footer">© Newspaper Group 2020</div></div></body></html>', [H, "Ferry and free buses to replace it.", P1, P2, P3]),
]
