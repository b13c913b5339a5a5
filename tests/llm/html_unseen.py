"""Ten pages that were written after op3's model and read once by it; nothing in op3 was changed after that reading. << and >> stand around main text."""

PAGES = {
    "museum": """<html lang=en><body><div class="skip"><a href="#c">Skip to content</a></div><div class="banner-top"><img alt=""><span>Maritime Museum</span></div><div class="mega-menu"><ul><li><a href="/v">Visit</a></li><li><a href="/e">Exhibitions</a></li><li><a href="/s">Shop</a></li></ul></div>
<div class="exhibit-detail"><h1><<The whaler's chart room>></h1><div class="exhibit-copy"><p><<This cabin was taken whole from a ship that was broken up in 1911.>></p><p><<Its drawers still held forty charts, most of them corrected by hand in three inks.>></p><ol><li><<Look for the coffee stain near Cape Horn.>></li><li><<The lamp swings on its own gimbal.>></li></ol></div></div>
<div class="visit-box"><h3>Plan your visit</h3><p>Open daily from ten to five</p></div><div class="legal">Registered charity 10442</div></body></html>""",
    "forum_howto": """<body><table class="outer"><tr><td class="menu-left"><a href=1>FAQ</a><br><a href=2>Rules</a></td><td class="main-cell"><div class="howto"><h2><<Bleeding a bicycle brake>></h2><p><<Hold the lever at about thirty degrees and open the bleed port first.>><p><<Push the fluid through slowly, so that no air is drawn past the seal.>><pre><<1 open port   2 push 5 ml   3 close>></pre></div>
<div class="answers"><div class="answer"><p>Worked for me, thanks a lot!</p></div><div class="answer"><p>Mine needed a second round.</p></div></div></td></tr></table><p class="foot">Board software 2.1</p></body>""",
    "science": """<body class="journal"><header role="banner"><a href="/">Annals of Soil</a><form role="search"><input><button>Find</button></form></header><main><article><h1><<Worm casts as a measure of tilth>></h1><p class="authors">R. Okafor, L. Brandt</p><section class="abstract"><h2><<Abstract>></h2><p><<We counted casts on 200 plots over four years and compared them with crumb size.>></p></section><section><h2><<Results>></h2><p><<Plots with more than thirty casts a square metre had crumbs a third larger on average.>></p><table><tr><td><<clay>></td><td><<31>></td></tr><tr><td><<loam>></td><td><<44>></td></tr></table></section></article></main><aside class="metrics"><p>Cited by 12</p><ul><li><a href="/c">Cite this</a></li></ul></aside><footer><p>ISSN 0000-1111</p></footer></body>""",
    "spanish": """<body><div id="cabecera"><h1>Diario del Valle</h1><ul><li><a href="/p">Portada</a></li><li><a href="/d">Deportes</a></li></ul></div><div id="cuerpo"><div class="noticia"><h2><<Reabre el mercado de la plaza>></h2><p><<Tras dos a&ntilde;os de obras, los puestos volvieron a abrir el s&aacute;bado por la ma&ntilde;ana.>></p><p><<Los vecinos hicieron cola desde las siete, y a mediod&iacute;a no quedaba pan.>></p></div><div class="publicidad"><p>Ofertas de verano en muebles</p></div></div><div id="pie"><p>Todos los derechos reservados</p></div></body>""",
    "letter": """<body><div><div><p><<Dear members,>></p><p><<the annual meeting will be held on the second of March in the old school, and all are welcome to bring soup.>></p><p><<We have to choose a new treasurer, since Ida moves to the coast after nineteen years of careful books.>></p><p><<With kind regards, the board>></p></div><div><a href="/">Back to start</a> <a href="/k">Contact</a></div></div></body>""",
    "product_story": """<body><div class="cookie-consent-overlay"><p>We value your privacy. Choose which cookies we may use.</p><button>All</button><button>None</button></div><nav class="topnav"><a href="/">Kiln &amp; Co</a><a href="/cart">Cart</a></nav><div class="story-page"><h1><<Why we fire twice>></h1><div class="rich-text"><p><<A single firing leaves the glaze thin at the rim, where lips and spoons meet it.>></p><p><<So every cup goes back for a second night, at a lower heat, and comes out the colour of wet slate.>></p><blockquote><<It costs us a day, but a cup lasts longer than a day.>></blockquote></div></div><div class="product-carousel"><h2>Shop the range</h2><ul><li><a href="/1">Cup, slate</a></li><li><a href="/2">Bowl, slate</a></li></ul></div><div class="newsletter"><form><label>Ten percent off your first order</label><input></form></div><footer class="site-footer"><ul><li><a href="/t">Terms</a></li></ul></footer></body>""",
    "wiki": """<body><div id="siteNotice"><p>Give today and keep us free.</p></div><div id="content"><h1 id="firstHeading"><<Reed bunting>></h1><div id="bodyContent"><div id="siteSub">From the open field guide</div><p><<The reed bunting is a bird of wet margins, seldom far from willow scrub.>></p><div id="toc"><ul><li><a href="#d">Description</a></li><li><a href="#v">Voice</a></li></ul></div><h2><<Description>></h2><p><<Males in spring have a black head and a white collar; females are streaked with brown.>></p><h2><<Voice>></h2><p><<The song is short, halting, and ends as if the bird had forgotten the rest.>></p></div></div><div id="mw-panel"><ul><li><a href="/r">Random page</a></li></ul></div><div id="footer"><p>This page was last edited in May.</p></div></body>""",
    "gov": """<body><div class="usa-banner"><p>An official website of the county</p></div><div class="grid-row"><div class="grid-col-3"><ul class="usa-sidenav"><li><a href="/a">Permits</a></li><li><a href="/b">Taxes</a></li></ul></div><div class="grid-col-9"><h1><<Burning garden waste>></h1><p><<You may burn dry garden waste between October and April if the fire is thirty metres from any building.>></p><ul><li><<Call the fire line on the morning of the day.>></li><li><<Keep water at hand until the ashes are cold.>></li></ul><div class="alert-box"><p>Offices are closed on Friday.</p></div></div></div><div class="usa-footer"><p>County of Alder, Box 4</p></div></body>""",
    "interview": """<body><div class="wrapper"><div class="brand">Slow Radio</div><div class="episode"><h1><<Talking with a piano tuner>></h1><p class="lede"><<She has tuned the same three hundred pianos for thirty years.>></p><dl><dt><<What do you listen for?>></dt><dd><<The beats between two strings, and then their absence.>></dd><dt><<Do pianos remember you?>></dt><dd><<They remember the weather, which is most of what I undo.>></dd></dl></div><div class="subscribe-strip"><p>Never miss an episode</p><form><input></form></div><div class="disqus-thread"><h3>2 responses</h3><p>What a lovely conversation this was.</p></div></div></body>""",
    "spa": """<body><div id=root><div class="sc-a1"><div class="sc-hd"><a href=/>Trailhead</a><button>Log in</button></div><div class="sc-b2"><div class="sc-c3"><h1 class="sc-t"><<Crossing the moor in fog>></h1><div class="sc-p"><<Take a bearing before the cloud comes down, not after.>></div><div class="sc-p"><<Count your paces between the walls; the sheep tracks all look like paths and none of them lead home.>></div></div><div class="sc-d4"><div class="sc-card"><a href=/x>Boots we like</a></div><div class="sc-card"><a href=/y>Ten tea stops</a></div></div></div><div class="sc-ft">Made in the hills</div></div></div></body>""",
}
