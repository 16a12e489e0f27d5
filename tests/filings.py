"""Two made-up filings with tables of contents, personal data and odd markup."""

LONG = " ".join(
    f"Orchard revenue in region {i} moved by {i}.5 percent as harvest contracts renewed." for i in range(30)
)

ORCHARD = f"""<?xml version="1.0"?><!-- cover
page --><html><HEAD><title>x</title><style>p {{ color: red }}</style>
<script type="text/javascript">var a = "</p>";</script></HEAD><body>
<p>Orchard Systems Ltd&#46; &mdash; quarterly report</p>
<table><tr><td>Item 1.&nbsp;Accounts</td></tr><tr><td>Item 2. Discussion of harvest</td></tr></table>
<p>PART I</p>
<h2>Item 1. Accounts</h2><p>Orchard cider takings grew 31% on perry &amp; juice.</p>
<h2>Item 2. Discussion of harvest</h2><p>{LONG}</p>
<p>Part II</p>
<h2>ITEM 1. Legal matters</h2><p>Write to pat.lee@orchard.example or (312) 555-0176.
SSN 561-40-7732, account number 4400917726105.</p>
<h2>Item 1A. Risk factors</h2><p>Our pruning robots may fail in frost.</p>
</body></html>"""

HARBOR = """<html><body><div>Item 7. Freight overview</div><div>Part II</div>
<p>Item 7. Freight overview</p><p>Harbor volumes fell as warehouses consolidated; dock fees were flat.</p>
<p>Item 8. Statements</p><p>Lease liabilities and freight accruals are listed in the notes.</p></body></html>"""

FILINGS = [
    ("0000000001", "0000000001-26-000001", "Orchard Systems Ltd.", "10-Q", "2026-05-01", ORCHARD),
    ("0000000002", "0000000002-26-000002", "Harbor Lines Co.", "10-K", "2026-02-20", HARBOR),
]
